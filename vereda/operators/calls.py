"""Tool calls that a model wrote into its answer."""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: marks around the calls of an answer ---
BLOCK = r"(?s)<\|tool_call_start\|>(.*?)<\|tool_call_end\|>"

FOUND = "array<struct<name: string, arguments: string, reason: string>>"


def without_calls(text: Column) -> Column:
    """The answer less its calls."""
    return F.regexp_replace(F.regexp_replace(text, BLOCK, ""), r"^\s+|\s+$", "")


def _value(node: ast.expr) -> str:
    """JSON of a literal; of anything else the JSON string of its source."""
    try:
        value = ast.literal_eval(node)
        if isinstance(value, (set, frozenset)):
            value = sorted(value, key=repr)
        return json.dumps(value, allow_nan=False)
    except (ValueError, TypeError):
        return json.dumps(ast.unparse(node))


def _read(block: str, tools: Mapping[str, Sequence[str]]) -> list[tuple[str | None, str | None, str | None]]:
    """(name, arguments, reason) of each call of a block, or one row with the reason why it cannot be read."""
    try:
        tree = ast.parse(block.strip(), mode="eval").body
        found = []
        for node in tree.elts if isinstance(tree, (ast.List, ast.Tuple)) else [tree]:
            if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Name):
                found.append((None, None, "not a call"))
                continue
            named = dict(zip(tools.get(node.func.id, ()), map(_value, node.args)))
            named |= {k.arg or "**": _value(k.value) for k in node.keywords}
            found.append((node.func.id, "{" + ", ".join(f"{json.dumps(k)}: {v}" for k, v in named.items()) + "}", None))
        return found
    except (RecursionError, MemoryError):
        return [(None, None, "nested too deep")]
    except (SyntaxError, ValueError):
        return [(None, None, "syntax")]


def parsed(answers: DataFrame, text: str, tools: Mapping[str, Sequence[str]]) -> DataFrame:
    """The other columns of answers with block, call (places from 0), name, arguments (a JSON object) and reason, a row per call.

    tools: the parameter names of each tool, in order, for arguments without a name; an unknown tool keeps its named ones
    only, and of a name given twice the last counts. Values that are no literals stay as source text. A block that cannot be
    read is one row with NULL name and reason `syntax` or `nested too deep`; a member that is no call of a plain name
    has reason `not a call`; an empty list of calls, a text without blocks and a NULL text give no row. Blocks are cut out
    by the built-in functions, only they pass to Python, in Arrow batches.
    """
    def run(blocks: pd.Series) -> pd.Series:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            return blocks.map(lambda b: _read(b, tools))

    kept = [c for c in answers.columns if c != text]
    blocks = answers.select(*kept, F.posexplode(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))).alias("block", "__source"))
    calls = blocks.withColumn("__found", F.pandas_udf(run, FOUND)(F.col("__source")))
    return calls.select(*kept, "block", F.posexplode("__found").alias("call", "__call")).select(*kept, "block", "call", "__call.*")

"""Scalar text functions as Spark Columns: no Python runs per row."""

from __future__ import annotations

import html.entities
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Latin letters whose canonical decomposition starts with one base letter.
@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    src, dst, compose = [], [], {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        nfd = unicodedata.normalize("NFD", ch)
        if len(nfd) > 1 and all(unicodedata.combining(c) for c in nfd[1:]):
            src.append(ch)
            dst.append(nfd[0])
            compose[nfd] = ch
            if len(nfd) > 2:
                # the partly composed spelling of a letter with two marks
                half = unicodedata.normalize("NFC", nfd[:2])
                compose.setdefault(half + nfd[2:], ch)
    return "".join(src), "".join(dst), compose


def unaccent(c) -> Column:
    """Drop diacritics, keep case."""
    src, dst, _ = _accent_tables()
    return let(_col(c), lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(
        F.translate(t, src, dst), r"\p{Mn}", "")).otherwise(t))


def normalize(c) -> Column:
    """Lower-case, unaccented form used by every rule; NULL becomes ''."""
    return F.lower(unaccent(F.coalesce(_col(c), F.lit(""))))


def nfc(c) -> Column:
    """Canonical composition of Latin letters.

    Text without combining marks skips the work. Otherwise it is cut into
    letter clusters and each known cluster is replaced by its composed letter.
    """
    c = _col(c)
    _, _, compose = _accent_tables()
    pairs = F.create_map(*[F.lit(x) for kv in compose.items() for x in kv])
    clusters = F.regexp_extract_all(c, F.lit(r"(?s)(\P{M}\p{M}*|\p{M}+)"), F.lit(1))
    joined = F.array_join(
        F.transform(clusters, lambda x: F.coalesce(F.try_element_at(pairs, x), x)), "")
    return F.when(c.rlike(r"\p{M}"), joined).otherwise(c)


def strip(c) -> Column:
    """Trim every kind of white space on both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def clean(c, max_newlines: int = 1, compose: bool = True) -> Column:
    """Collapse blanks and newline runs; empty becomes NULL."""
    t = nfc(c) if compose else _col(c)
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    if max_newlines == 1:
        t = F.regexp_replace(t, r"[ \t]*\n[ \t\n]*", "\n")
    else:
        t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
        t = F.regexp_replace(t, r"\n{%d,}" % (max_newlines + 1), "\n" * max_newlines)
    return F.nullif(strip(t), F.lit(""))


@lru_cache(maxsize=1)
def _entities() -> tuple:
    return tuple((f"&{n};", chr(cp)) for n, cp in html.entities.name2codepoint.items()) + (
        ("&apos;", "'"),)


def unescape(c) -> Column:
    """Decode named and numeric character references."""
    named = F.create_map(*[F.lit(x) for kv in _entities() for x in kv])

    def from_hex(digits: Column) -> Column:
        return F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    def decode(x: Column) -> Column:
        dec = F.regexp_extract(x, r"^&#([0-9]+);$", 1)
        hexa = F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        return (F.when(~x.startswith("&"), x)
                .when(dec != "", from_hex(F.hex(dec.cast("long"))))
                .when(hexa != "", from_hex(hexa))
                .otherwise(F.coalesce(F.try_element_at(named, x), x)))

    def whole(t: Column) -> Column:
        pieces = F.regexp_extract_all(
            t, F.lit(r"(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"), F.lit(1))
        return F.when(t.contains("&"), F.array_join(F.transform(pieces, decode), "")).otherwise(t)

    return let(_col(c), whole)


# What `tidy` changes holds one of these; all other text it returns as it is.
UNTIDY = "(?U)[&\t\n\u00a0\u200b\ue000\u0001]|  | [,.;:!?%)\\]]|[(\\[] |^\\s|\\s$"


def tidy(c) -> Column:
    """Decode references, collapse blanks, glue punctuation back; NULL gives ''."""
    return let(F.coalesce(_col(c), F.lit("")), lambda t: F.when(t.rlike(UNTIDY), _tidied(t)).otherwise(t))


def _tidied(t: Column) -> Column:
    t = unescape(t)
    t = F.translate(t, "\u00a0\u200b\ue000", " \u0001\n")
    t = F.replace(t, F.lit("\u0001"), F.lit(""))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"[ \t]*\n[ \t]*", "\n")
    t = F.regexp_replace(t, r" +([,.;:!?%)\]])", "$1")
    t = F.regexp_replace(t, r"([(\[]) +", "$1")
    return strip(t)


def slug(c) -> Column:
    s = F.regexp_replace(normalize(c), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("sem_titulo")).otherwise(s)


def name_key(c) -> Column:
    """Comparison key of a person's name."""
    return F.trim(F.regexp_replace(normalize(c), r"[^a-z0-9 ]", ""))


def summary(c, limit: int = 400) -> Column:
    """First sentences up to `limit` characters, never cutting a word."""
    t = strip(F.coalesce(_col(c), F.lit("")))
    cut = F.left(t, F.lit(limit))
    # Index (0-based) of the last sentence end or newline, -1 when there is none.
    dot = F.greatest(last_index(cut, ". "), last_index(cut, "\n"))
    space = last_index(cut, " ")
    at_word = F.when(space >= 0, strip(F.substr(cut, F.lit(1), space))).otherwise(strip(cut))
    return (F.when(t == "", F.lit(None).cast("string"))
            .when(F.length(t) <= limit, t)
            .when(dot > limit * 0.5, strip(F.substr(cut, F.lit(1), dot + 1)))
            .otherwise(F.concat(at_word, F.lit("…"))))


def last_index(c: Column, needle: str) -> Column:
    """0-based index of the last occurrence of `needle`, -1 if absent."""
    pos = F.instr(F.reverse(c), needle[::-1])
    return F.when(pos == 0, F.lit(-1)).otherwise(F.length(c) - pos - len(needle) + 1)


def word_count(c) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?U)(\w+)"), F.lit(1)))


def words(c) -> Column:
    """Tokens separated by white space."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+"), lambda x: x != "")


def tokens(c) -> Column:
    """Lower-case alphanumeric tokens."""
    return F.filter(
        F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


# The two word lists of the symbolic sentiment rule.
POSITIVE = ("bom", "ótimo", "excelente", "adorei", "perfeito")
NEGATIVE = ("ruim", "péssimo", "horrível", "odiei", "terrível")


def sentiment(c, positive=POSITIVE, negative=NEGATIVE) -> Column:
    t = F.lower(_col(c))

    def hits(terms):
        return F.size(F.filter(F.array(*[F.lit(x) for x in terms]), lambda w: F.contains(t, w)))

    p, n = hits(positive), hits(negative)
    return F.when(p > n, "Positivo").when(n > p, "Negativo").otherwise("Neutro")


# --- numbers, dates, codes ---------------------------------------------------

def to_int(c) -> Column:
    """First signed integer, thousands dots ignored."""
    digits = F.regexp_extract(F.replace(_col(c).cast("string"), F.lit("."), F.lit("")), r"(-?\d+)", 1)
    return digits.try_cast("bigint")


def to_date_br(c) -> Column:
    """First dd/mm/yyyy in the text as a date; an impossible date is NULL."""
    found = F.regexp_extract(_col(c), r"(\d{2}/\d{2}/\d{4})", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "dd/MM/yyyy")


def to_time(c) -> Column:
    """Leading HH:MM as 'HH:mm', NULL when out of range."""
    h = F.regexp_extract(_col(c), r"^\s*(\d{1,2}):(\d{2})", 1)
    m = F.regexp_extract(_col(c), r"^\s*(\d{1,2}):(\d{2})", 2)
    ok = (h.try_cast("int") <= 23) & (m.try_cast("int") <= 59)
    return F.when(ok, F.concat(F.lpad(h, 2, "0"), F.lit(":"), m))


# Month names.
MONTHS = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho",
          "agosto", "setembro", "outubro", "novembro", "dezembro")


def long_date(c) -> Column:
    d = _col(c)
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "),
                    F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(d)),
                    F.lit(" de "), F.year(d).cast("string"))


def month_number(c) -> Column:
    """Month name, accents ignored, to 1..12."""
    pos = F.array_position(
        F.array(*[F.lit(unicodedata.normalize("NFD", m).encode("ascii", "ignore").decode())
                  for m in MONTHS]), normalize(c))
    return F.nullif(pos, F.lit(0)).cast("int")


def parse_long_date(c) -> Column:
    """'15 de julho de 2026' anywhere in the text."""
    t = normalize(c)
    pattern = r"(\d{1,2})º?\s+de\s+([a-z]+)\s+de\s+(\d{4})"
    day, month, year = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3))
    iso = F.concat_ws("-", year, F.lpad(month_number(month).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(day != "", F.try_to_date(iso, "yyyy-MM-dd"))


def iso_datetime(c) -> Column:
    return F.try_to_timestamp(_col(c))


def semester_of(c) -> Column:
    m = F.month(_col(c))
    return F.when(m.isNotNull(), F.when(m <= 6, 1).otherwise(2))


YEAR_SEMESTER = r"\b(20\d{2})\s*[/\-.]\s*([12])\b"
YEAR = r"\b(20\d{2})\b"


def year_semester(*cols) -> Column:
    """(year, semester) from the first text naming both, else the first bare year."""
    cs = [F.coalesce(_col(c), F.lit("")) for c in cols]
    both = [F.when(c.rlike(YEAR_SEMESTER), F.struct(
        F.regexp_extract(c, YEAR_SEMESTER, 1).try_cast("int").alias("year"),
        F.regexp_extract(c, YEAR_SEMESTER, 2).try_cast("int").alias("semester"))) for c in cs]
    bare = [F.when(c.rlike(YEAR), F.struct(
        F.regexp_extract(c, YEAR, 1).try_cast("int").alias("year"),
        F.lit(None).cast("int").alias("semester"))) for c in cs]
    return F.coalesce(*both, *bare)


def cited_years(*cols) -> Column:
    text = F.concat_ws(" ", *[_col(c) for c in cols])
    found = F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


WEEKDAYS = ("SEG", "TER", "QUA", "QUI", "SEX", "SAB", "DOM")


def weekday(c) -> Column:
    d = F.left(F.trim(F.upper(unaccent(c))), F.lit(3))
    return F.when(d.isin(*WEEKDAYS), d)


def semester_number(c) -> Column:
    return F.regexp_extract(normalize(c), r"^\s*(\d{1,2})\s*[°ºo]?\s*sem", 1).try_cast("int")


def curriculum_block(c) -> Column:
    r = normalize(c)
    return (F.when(r.contains("optativ"), "optativas")
            .when(r.contains("complementar"), "complementares").otherwise("semestre"))


def class_key(subject, year, semester, code) -> Column:
    zero = F.lit(0)
    return F.concat_ws("-", _col(subject), F.coalesce(_col(year), zero).cast("string"),
                       F.coalesce(_col(semester), zero).cast("string"), _col(code))


def href_id(c, kind: str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), rf"/{kind}/(?:id|cod)/([A-Za-z0-9_-]+)", 1), F.lit(""))


# --- presentation --------------------------------------------------------------

def truncate(c, n: int, marker: str = " [...]") -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(marker))).otherwise(c)


def snippet(c, terms, before: int = 100, after: int = 300, head: int = 250) -> Column:
    """Text around the first listed term that occurs, else the beginning."""
    c = _col(c)
    low = F.lower(c)
    needles = [F.lower(t) if isinstance(t, Column) else F.lit(t.lower()) for t in terms]
    out = strip(F.left(c, F.lit(head)))
    for term in reversed(needles):
        at = F.position(term, low)
        start = F.greatest(F.lit(1), at - before)
        out = F.when(at > 0, strip(F.substr(c, start, at + after - start))).otherwise(out)
    return out


def labelled(label: str, c) -> Column:
    """'label: value', NULL (so dropped by concat_ws) when the value is empty."""
    c = _col(c).cast("string")
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))


def join_lines(*cols, sep: str = "\n") -> Column:
    return F.concat_ws(sep, *[F.nullif(_col(c), F.lit("")) for c in cols])


def readable_path(c) -> Column:
    return F.replace(F.replace(_col(c), F.lit("-"), F.lit(" ")), F.lit("/"), F.lit(" › "))


def display_label(c, labels: dict[str, str]) -> Column:
    c = _col(c)
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), c)


def contains_unaccented(a, b) -> Column:
    return F.contains(normalize(a), normalize(b))


def contains_any(c, terms, min_len: int = 4) -> Column:
    """Any term occurs, ignoring case; short terms count only if all are short."""
    kept = [t for t in terms if len(t) >= min_len] or list(terms)
    low = F.lower(_col(c))
    out = F.lit(False)
    for t in kept:
        out = out | F.contains(low, F.lit(t.lower()))
    return out


# --- trigram sets ---------------------------------------------------------------

def word_trigrams(c) -> Column:
    """Trigram set of each padded word ('  w '), the name-lookup similarity."""
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(
        padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2),
                                      lambda i: F.substring(w, i, F.lit(3))))))


def string_trigrams(c) -> Column:
    """Trigram set of the whole padded string, the response-cache similarity."""
    # Letters first: indexing an array is constant time, a substring is not.
    chars = F.regexp_extract_all(F.concat(F.lit("  "), _col(c), F.lit("  ")), F.lit("(?s)(.)"), F.lit(1))
    grams = F.transform(F.array(chars), lambda a: F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.concat(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))))
    return F.element_at(grams, 1)


def jaccard(a, b) -> Column:
    a, b = _col(a), _col(b)
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def question_key(c) -> Column:
    """Normal form of a question for the response cache."""
    q = strip(F.lower(_col(c)))
    q = F.regexp_replace(q, r"(?U)\s+", " ")
    return strip(F.regexp_replace(q, r"[?!.,;]$", ""))

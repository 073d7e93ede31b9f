"""Secret scans: key patterns, and candidate strings of high entropy in a sliding window.

Spark's regular expressions return strings, not places, so places come from the text
between matches: the pieces of a split and the matches alternate, and their lengths in
code points add up to each match's start.

The entropy rule slides a window over each candidate. Counts of its characters are kept in
an array; as one comes in and one goes out, sum(c * log2 c) changes by four terms, and the
window's entropy is log2 w - sum / w. Candidates are runs of one character class, the
smallest class that holds the run, and each class has its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.llm.text import bind, running

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A run of at least this many characters is a candidate.
RUN = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Fixed values: (class, pattern of a whole candidate, bits a character in the window that flag it).
CLASSES = (
    ("hex", r"^[0-9a-fA-F]+$", 3.02),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", 3.62),
    ("base64", r"^[0-9A-Za-z+/_=-]+$", 3.82),
)
#: What looks random and is public. Digits alone; words (lower case, capitalised, camel case or upper case) with
#: separators; uuids; values, taken after the last "=", that are a placeholder's name with letters and four digits at most around it,
#: one character repeated, or rising runs; paths of words.
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^[+/_=-]*(([A-Z]?[a-z]{2,})+|[A-Z]+)([+/_=-]+(([A-Z]?[a-z]{2,})+|[A-Z]+))*[+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^(.*=)?[a-z_-]*(example|placeholder|changeme|dummy|sample|xxxx)[a-z_-]*[0-9]{0,4}$",
    r"(?i)^(.*=)?(0?123456789|abcdef(ghijkl(mnopqr(stuvwxyz)?)?)?|[+/_-])+[0-9a-f]{0,5}$",
    r"^(/?[a-z]+)+(/[a-z0-9_-]+)+/?$",
)
_MATCH = "struct<start:bigint,end:bigint,kind:int,value:string>"


def matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """array<struct<start, end, kind, value>> of the matches, leftmost first, without overlap; places in code points."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        lengths = F.zip_with(gaps, found, lambda g, v: (F.char_length(g) + F.char_length(v)).cast("long"))

        def at(pair: Column) -> Column:
            first = pair["before"] + F.char_length(pair["gap"])
            return F.struct(first.alias("start"), (first + F.char_length(pair["value"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), pair["value"].alias("value"))

        pairs = F.zip_with(F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), running(lengths, lambda a, x: a + x, F.lit(0).cast("long")),
            lambda p, b: F.struct(p["value"].alias("value"), p["gap"].alias("gap"), b.alias("before")))
        return F.transform(pairs, at)

    none = F.array().cast(f"array<{_MATCH}>")
    found = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(placed(f)))
    return found if keep is None else F.filter(found, lambda m: keep(m["value"]))


def outside(base: Column, more: Column) -> Column:
    """The matches of ``more`` that don't lie inside one of ``base``. In one order of both, what holds a match begins before it and ends no earlier than it."""
    as_span = lambda own: lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("back"), F.lit(int(own)).alias("own"), m.alias("m"))
    ordered = F.array_sort(F.concat(F.transform(base, as_span(False)), F.transform(more, as_span(True))))

    def of(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: F.when(s["own"] == 0, -s["back"]).otherwise(F.lit(-1).cast("long")))
        reach = running(ends, lambda a, x: F.greatest(a, x), F.lit(-1).cast("long"))
        told = F.zip_with(spans, reach, lambda s, r: F.when((s["own"] == 1) & (r < s["m"]["end"]), s["m"]))
        return F.filter(told, lambda m: m.isNotNull())

    return F.when(F.size(base) == 0, more).when(F.size(more) == 0, more).otherwise(bind(ordered, of))


def by_start(spans: Column) -> Column:
    """Spans by start, then kind."""
    keyed = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"))))
    return F.transform(keyed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["value"].alias("value")))


def _clog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def peak_entropy(value: Column, width: int = RUN) -> Column:
    """The largest entropy, in bits a character, of the windows of ``width`` characters of ``value``."""

    def of(codes: Column) -> Column:
        state = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def step(s: Column, at: Column) -> Column:
            into, gone = F.element_at(codes, at), F.when(at > width, F.get(codes, at - width - 1)).otherwise(F.lit(-1))
            n_in = F.element_at(s["counts"], into)
            same = into == gone
            n_out = F.when(gone > 0, F.element_at(s["counts"], F.greatest(gone, F.lit(1)))).otherwise(F.lit(0))
            change = F.when(same, 0.0).otherwise(_clog(n_in + 1) - _clog(n_in) + F.when(gone > 0, _clog(n_out - 1) - _clog(n_out)).otherwise(0.0))
            total = s["sum"] + change
            counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda c, k: c + F.when(k + 1 == into, 1).when(k + 1 == gone, -1).otherwise(0)))
            best = F.when(at >= width, F.greatest(s["best"], F.log2(F.lit(float(width))) - total / width)).otherwise(s["best"])
            return F.struct(counts.alias("counts"), total.alias("sum"), best.alias("best"))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), state, step, lambda s: s["best"])

    codes = F.transform(F.split(value, ""), lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(F.lit(len(ALPHABET) + 1)))
    return F.when(F.char_length(value) < width, F.lit(0.0)).otherwise(bind(codes, of))


def flagged(value: Column) -> Column:
    limit = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        limit = F.when(F.rlike(value, F.lit(pattern)), bits).otherwise(limit)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | F.rlike(value, F.lit(pattern))
    return F.when(allowed, False).otherwise(peak_entropy(value) >= limit)


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, base and all found spans as arrays of (start, end, kind, value) by start, then kind.

    Kinds: assign (value of 6 characters or more after a key word), access (key ids), hex (24
    digits or more), entropy (candidates above their class's bits that no allow rule holds
    and that aren't inside a base span). Null texts are empty; texts without matches have empty arrays. Rows are
    independent: repeated ones give equal rows, an empty table none. Only id and text are read, so other columns can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    t = F.col("text")
    long_value = lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 6
    rows = rows.select("id", by_start(F.concat(matches(t, ASSIGN, "assign", long_value), matches(t, ACCESS, "access"), matches(t, HEX, "hex"))).alias("base"), matches(t, CANDIDATE, "entropy", flagged).alias("more"))
    return rows.select("id", "base", by_start(F.concat(F.col("base"), outside(F.col("base"), F.col("more")))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"].cast("string"), m["end"].cast("string"))), ",")


def redacted(df: DataFrame, text_col: str, spans: str, mark: str = "[secret]") -> DataFrame:
    """``df`` with its spans' characters replaced by ``mark``; overlapping spans merge into one mark. Null texts become empty.

    ``spans`` are by start. What lies between them is cut out piece by piece and joined once. Columns keep their names, whatever they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of(found: Column) -> Column:
        reach = running(F.transform(found, lambda m: m["end"]), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
        piece = lambda a, n: F.substr(text, (a + 1).cast("int"), n.cast("int"))
        head = F.zip_with(found, reach, lambda m, r: F.when(m["start"] < r, F.lit("")).otherwise(F.concat(piece(r, m["start"] - r), F.lit(mark))))
        last = F.aggregate(found, F.lit(0).cast("long"), lambda a, m: F.greatest(a, m["end"]))
        return F.concat(F.array_join(head, ""), piece(last, F.char_length(text)))

    return df.withColumn(text_col, F.when(F.size(spans) == 0, text).otherwise(bind(F.col(spans), of)))

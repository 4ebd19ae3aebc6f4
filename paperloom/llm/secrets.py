"""Secret scan in DataFrame functions: fixed patterns, and candidate strings of high entropy in a sliding window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: (kind, pattern, group whose length counts, its least length).
BASE = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", "([0-9a-f]{32,})", 1, 32),
]
#: Character classes of candidates: (class, pattern of the whole string, alphabet, least entropy in bits of a window).
CLASSES = [
    ("hex", "^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    ("base64", "^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
]
WINDOW = 20
#: Whole runs of candidate characters that have a digit and a letter.
CANDIDATE = r"((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{%d,})"
#: The allow-list. Windows that hold a placeholder or counting are not looked at, so that chance hits in a long string
#: hide no more than themselves.
PLACEHOLDERS = "(?i)example|sample|placeholder|dummy|changeme|your[_-]|0123456789|abcdefgh|987654321"
#: A candidate of two such segments or more and of no other is a path, a name of words, a date or a time.
SEGMENT = "^(?:[A-Za-z]{1,20}[0-9]{0,4}|[0-9]{1,8}|[a-z0-9]{1,4}|[0-9]{1,2}T[0-9]{1,6}Z?)$"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Matches that one pass adds to a block before the block is added to the others.
BLOCK = 256
#: The order of kinds of spans that start together.
KINDS = [*(k for k, *_ in BASE), "entropy"]


def _spans(text: Column, kind: str, pattern: str, passes) -> Column:
    """array<struct(start, kind number, end, kind, match)> of the matches that pass; places count code points.

    The text is split at the matches, so that places are sums of lengths; one pass keeps the running sum. Texts
    without a match skip it.
    """
    number = F.lit(KINDS.index(kind))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string,match:string>>")

    def found(x: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            start = a["end"] + F.length(x["between"][k])
            end = start + F.length(x["whole"][k])
            span = F.struct(start.alias("start"), number.alias("number"), end.alias("end"), F.lit(kind).alias("kind"), x["whole"][k].alias("match"))
            return F.struct(end.alias("end"), F.when(passes(x["whole"][k], x["group"][k]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        def block(a: Column, k: Column) -> Column:
            places = F.sequence(k, F.least(k + BLOCK, F.size(x["whole"])) - 1)
            more = F.aggregate(places, F.struct(a["end"].alias("end"), none.alias("out")), step)
            return F.transform(F.array(more), lambda m: F.struct(m["end"].alias("end"), F.concat(a["out"], m["out"]).alias("out")))[0]

        # By blocks, as each addition copies what it adds to.
        start = F.struct(F.lit(0).alias("end"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["whole"]) - 1, F.lit(BLOCK)), start, block, lambda a: a["out"])

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("group"), F.split(text, pattern, -1).alias("between"))
    return F.when(~text.rlike(pattern), none).otherwise(F.transform(F.array(parts), found)[0])


def _sum_of_logs(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of text that has characters of the alphabet alone; -1 without one.

    Counts of the window's characters are kept from step to step: the one that enters and the one that leaves change
    two counts and the sum of c log2 c.
    """
    # One count for each character of the alphabet; other characters share number 0.
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"))

    def largest(at: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            def moved(x: Column) -> Column:
                into, out = x["into"], x["out"]
                c_out = F.coalesce(F.get(a["counts"], out), F.lit(0))
                c_in = F.get(a["counts"], into) - F.when(into == out, 1).otherwise(0)
                s = a["s"] + F.when(out >= 0, _sum_of_logs(c_out - 1) - _sum_of_logs(c_out)).otherwise(0.0)
                s = s + _sum_of_logs(c_in + 1) - _sum_of_logs(c_in)
                counts = F.when(into == out, a["counts"]).otherwise(F.transform(a["counts"], lambda c, j: c + F.when(j == into, 1).when(j == out, -1).otherwise(0)))
                return F.struct(counts.alias("counts"), s.alias("s"))

            def judged(x: Column) -> Column:
                entropy = F.log2(F.lit(float(window))) - x["s"] / window
                best = F.when((i >= window - 1) & (F.get(x["counts"], F.lit(0)) == 0), F.greatest(a["best"], entropy)).otherwise(a["best"])
                return F.struct(x["counts"].alias("counts"), x["s"].alias("s"), best.alias("best"))

            ends = F.struct(F.get(at, i).alias("into"), F.when(i >= window, F.get(at, i - window)).otherwise(-1).alias("out"))
            return F.transform(F.transform(F.array(ends), moved), judged)[0]

        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), start, step, lambda a: a["best"])

    # The characters' numbers by one split, as a place in a long string is not found at once.
    numbers = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(alphabet), c)))
    return F.transform(F.array(numbers), largest)[0]


def _suspicious(match: Column, window: int) -> Column:
    segments = F.filter(F.split(match, "[/_=-]"), lambda x: x != "")
    allowed = match.rlike(UUID) | ((F.size(segments) > 1) & F.forall(segments, lambda x: x.rlike(SEGMENT)))
    masked, high = F.regexp_replace(match, PLACEHOLDERS, " "), F.lit(False)
    for _, pattern, alphabet, least in reversed(CLASSES):
        high = F.when(match.rlike(pattern), F.round(window_entropy(masked, alphabet, window), 6) >= least).otherwise(high)
    return ~allowed & high


def spans(text: Column, window: int = WINDOW) -> Column:
    """array<struct(start, number, end, kind, match)> of all secrets of a text, by start and then kind.

    Kinds: those of BASE, and entropy for candidate strings with a window of high entropy. Of a candidate that overlaps
    their spans each stretch outside is a candidate. The allow-list (PLACEHOLDERS, SEGMENT, UUID) suppresses candidates;
    base matches stay whatever they look like.
    """
    base = F.struct(*(_spans(text, kind, pattern, lambda _, group, n=least: F.length(group) >= n).alias(kind) for kind, pattern, _, least in BASE))
    more = _spans(text, "entropy", CANDIDATE % window, lambda match, group: F.lit(True))

    def merged(b: Column) -> Column:
        outside = F.flatten(F.transform(more, lambda m: _outside(m, [b[kind] for kind, *_ in BASE])))
        secret = F.filter(outside, lambda m: (F.length(m["match"]) >= window) & m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]") & _suspicious(m["match"], window))
        return F.sort_array(F.concat(*(b[kind] for kind, *_ in BASE), secret))

    return F.transform(F.array(base), merged)[0]


def _first(spans: Column, holds) -> Column:
    """Place of the first span for which holds, spans being sorted so that it holds for all that follow; by halving."""

    def step(a: Column, _: Column) -> Column:
        middle = F.call_function("shiftright", a["low"] + a["high"], F.lit(1))
        left = (a["low"] < a["high"]) & holds(F.get(spans, middle))
        right = (a["low"] < a["high"]) & ~holds(F.get(spans, middle))
        return F.struct(F.when(right, middle + 1).otherwise(a["low"]).alias("low"), F.when(left, middle).otherwise(a["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.floor(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.when(F.size(spans) == 0, 0).otherwise(F.aggregate(steps, start, step, lambda a: a["low"]))


def _outside(m: Column, kinds: list[Column]) -> Column:
    """The stretches of the span m that lie outside all spans; m itself if none overlaps it.

    The spans of a kind are sorted and apart, so that halving finds those that overlap m, however many there are.
    """

    def stretch(start: Column, end: Column) -> Column:
        match = F.substring(m["match"], start - m["start"] + 1, end - start)
        return F.array(F.struct(start.alias("start"), m["number"].alias("number"), end.alias("end"), m["kind"].alias("kind"), match.alias("match")))

    def step(a: Column, x: Column) -> Column:
        out = F.when(x["start"] > a["at"], F.concat(a["out"], stretch(a["at"], x["start"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

    def rest(a: Column) -> Column:
        return F.when(a["at"] < m["end"], F.concat(a["out"], stretch(a["at"], m["end"]))).otherwise(a["out"])

    def overlapping(spans: Column) -> Column:
        first = _first(spans, lambda x: x["end"] > m["start"])
        return F.transform(F.array(first), lambda f: F.slice(spans, f + 1, F.greatest(F.lit(0), _first(spans, lambda x: x["start"] >= m["end"]) - f)))[0]

    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string,match:string>>")
    cut = lambda near: F.when(F.size(near) == 0, F.array(m)).otherwise(F.aggregate(near, F.struct(m["start"].alias("at"), none.alias("out")), step, rest))
    return F.transform(F.array(F.sort_array(F.concat(*map(overlapping, kinds)))), cut)[0]


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with secrets: array<struct(start, number, end, kind, match)>, an empty one for a null, empty or clean text.

    One pass without a shuffle. Repeated rows, very long texts and other columns are no matter; a column named
    secrets is replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "secrets"]
    # explode keeps the optimizer from scanning again for each use of the column.
    return docs.select(*rest, F.explode(F.array(spans(F.coalesce("text", F.lit("")), window))).alias("secrets"))


def summary(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return scan(docs.select("doc_id", "text"), window).select("doc_id", *(count(kind) for kind, *_ in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", window: int = WINDOW) -> DataFrame:
    """docs with every span of a secret in text replaced by mark; spans that overlap or touch another's inside are one. A null text stays null.

    The text is cut at the spans in four bytes a character, where every place is found at once, and joined again, so
    that the work grows with the text and not with its square.
    """
    # The end of all spans before one is the last end before it of any kind, as those of a kind are sorted and apart.
    of = lambda kind: F.filter("secrets", lambda x: x["kind"] == kind).alias(kind)
    by_kind = F.struct(*map(of, KINDS))

    def joined(x: Column) -> Column:
        def end_before(span: Column, kind: str) -> Column:
            before = _first(x["kinds"][kind], lambda y: (y["start"] > span["start"]) | ((y["start"] == span["start"]) & (y["number"] >= span["number"])))
            return F.coalesce(F.get(x["kinds"][kind], before - 1)["end"], F.lit(0))

        def piece(span: Column) -> Column:
            def cut(end: Column) -> Column:
                between = F.decode(F.substring(x["wide"], 4 * end + 1, 4 * (span["start"] - end)), "UTF-32")
                return F.when(span["start"] < end, "").when(span["start"] == end, mark).otherwise(F.concat(between, F.lit(mark)))

            return F.transform(F.array(F.greatest(*(end_before(span, k) for k in KINDS))), cut)[0]

        last = F.greatest(*(F.coalesce(F.get(x["kinds"][k], F.size(x["kinds"][k]) - 1)["end"], F.lit(0)) for k in KINDS))
        tail = F.decode(F.substring(x["wide"], 4 * last + 1, F.octet_length(x["wide"])), "UTF-32")
        return F.concat(F.array_join(F.transform("secrets", piece), ""), tail)

    rest = F.transform(F.array(F.struct(by_kind.alias("kinds"), F.encode("text", "UTF-32").alias("wide"))), joined)[0]
    found = scan(docs, window)
    return found.select(*(F.when(F.size("secrets") == 0, F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))

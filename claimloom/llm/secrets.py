r"""Secret scans: fixed patterns, and windowed entropy over candidate strings.

Base spans, leftmost non-overlapping for each kind: ``assign`` (a keyword, an
assignment sign and a value of 8 characters or more), ``access`` (``AKIA`` ids of
16 or more) and ``hex`` (32 or more lower-case hex digits).

Entropy spans. Candidates are runs of ``CANDIDATE`` characters, MIN_RUN or longer, in
what is left between the leftmost matches of any base kind (so that what a base span
covers isn't reported again, but what stands beside it is), with a digit or several
changes of case. A window of WINDOW characters slides along. At each step the counts of
the character that enters and of the one that leaves change by one, and the sum of
n*log2(n), from which the entropy follows, by their differences; with them goes the
length of the stretch of characters of each class that ends here: hexadecimal digits,
letters and digits, all of the base-64 alphabet. The counts are packed into a few
integers, 5 bits each, so that a step costs the same however long the run and the window
are. A candidate is reported, whole, with the first class of whose windows one exceeds
its threshold. The allow-list suppresses placeholders, UUIDs, integrity hashes' names and
words joined by underscores, in candidates of up to ALLOW_RUN characters.

Offsets are code points. Spark has no function for the place of a match, so they
come from the lengths of the pieces between the matches, by running sums in blocks of
SUM_BLOCK; only documents that have a match are cut. All is column functions, in one
pass and without a shuffle.

Defined results: a null text counts as empty; without spans the string of spans
is empty and its digest that of the empty string; repeated rows each give a row;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm._shared import text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
#: kind, pattern, what must hold of a match besides, in the order that breaks ties
BASE = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    ("access", ACCESS, lambda m: F.length(m) >= 16),
    ("hex", HEX, lambda m: F.length(m) >= 32),
)
#: what base spans cover, as one pattern
ANY_BASE = "(" + ASSIGN[1:-1].replace("]+)", "]{8,})") + r"|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,})"
MIN_RUN, WINDOW = 20, 20
CANDIDATE = rf"([A-Za-z0-9+/_=-]{{{MIN_RUN},}})"
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: class, how many leading characters of ALPHABET it has, threshold in bits
CLASSES = (("hexdigits", 22, 3.0), ("alnum", 62, 3.6), ("base64", len(ALPHABET), 3.9))
#: a digit, or lower and upper case by turns
MIXED = r"[0-9]|(?<![a-z])(?:[a-z]++[A-Z]++){4}"
ALLOW_RUN = 64
PACK = 12
SUM_BLOCK = 256
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0000000|1234567",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(sha1|sha256|sha384|sha512|md5)[-=]",
    r"^/?([A-Za-z]+[/_=-]+)+([A-Za-z]+|[0-9]{1,6})?$",
    r"^[0-9]+$",
)


def with_value(value: Column, use) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column, first: Column | int = 0) -> Column:
    """The sums of the leading elements of values, an array of integers, up to each.

    An array that grows by an element a step is copied at each, so this goes by blocks."""

    def scan(at_least: Column, n: Column, value_at, start: Column) -> Column:
        seed = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("ends"))
        step = lambda acc, i: with_value(
            acc["at"] + value_at(i), lambda at: F.struct(at.alias("at"), F.concat(acc["ends"], F.array(at)).alias("ends"))
        )
        return F.when(n < 1, F.array().cast("array<int>")).otherwise(
            F.aggregate(F.sequence(at_least, at_least + n - 1), seed, step, lambda acc: acc["ends"])
        )

    def of(v: Column) -> Column:
        size = F.size(v)
        blocks = F.floor((size + (SUM_BLOCK - 1)) / SUM_BLOCK).cast("int")
        width = lambda k: F.least(F.lit(SUM_BLOCK), size - k * SUM_BLOCK)
        place = lambda k: k * SUM_BLOCK + 1
        within = lambda k: F.aggregate(F.sequence(place(k), place(k) + width(k) - 1), F.lit(0), lambda n, i: n + F.element_at(v, i))
        before = scan(F.lit(0), blocks - 1, within, F.lit(first))
        starts = F.concat(F.array(F.lit(first).cast("int")), before)
        each = lambda start, k: scan(place(k), width(k), lambda i: F.element_at(v, i), start)
        return F.when(size > 0, F.flatten(F.transform(starts, each))).otherwise(F.array().cast("array<int>"))

    return with_value(values, of)


def spans_of(text: Column, pattern: str, first: Column | int = 0) -> Column:
    """The matches of pattern, whose first group is all of it: array of (start, end, found).

    first is the place of the text's first character."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        moves = F.zip_with(gaps, F.transform(found, F.length), lambda gap, size: gap + size)  # the last gap has no match
        ends = running_sums(F.filter(moves, lambda m: m.isNotNull()), first)
        return F.zip_with(ends, found, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("found")))

    return with_value(F.regexp_extract_all(text, F.lit(pattern), 1), placed)


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def base_spans(text: Column) -> Column:
    def of_kind(rank: int) -> Column:
        kind, pattern, holds = BASE[rank]
        kept = F.filter(spans_of(text, pattern), lambda s: holds(s["found"]))
        spans = F.transform(kept, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"]))
        return F.when(text.rlike(pattern), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*map(of_kind, range(len(BASE)))))


def window_kind(run: Column, window: int = WINDOW) -> Column:
    """The first class of CLASSES with a window of run, of its characters alone, above its threshold; else null."""
    gain = F.array(*[F.lit(n * log2(n) if n else 0.0) for n in range(window + 2)])
    words = -(-len(ALPHABET) // PACK)

    def judged(codes: Column) -> Column:
        def packed(counts: Column, code: Column) -> Column:
            """The count of a code, from the packed counts."""
            word = F.element_at(F.array(*[counts[f"w{k}"] for k in range(words)]), F.floor((code - 1) / PACK).cast("int") + 1)
            return F.call_function("shiftright", word, (code - 1) % PACK * 5).bitwiseAND(31).cast("int")

        def one(code: Column, k: int) -> Column:
            here = (code > k * PACK) & (code <= (k + 1) * PACK)
            return F.when(here, F.call_function("shiftleft", F.lit(1).cast("long"), (code - 1) % PACK * 5)).otherwise(F.lit(0).cast("long"))

        def moved(acc: Column, x: Column) -> Column:
            enters, leaves = x["enters"], x["leaves"]
            # the leaving character goes first, then the other enters
            f = lambda n: F.element_at(gain, n + 1)
            n_out = F.when(leaves > 0, packed(acc["counts"], leaves)).otherwise(F.lit(0))
            n_in = packed(acc["counts"], enters) - F.when(enters == leaves, 1).otherwise(0)
            counts = F.struct(*[(acc["counts"][f"w{k}"] + one(enters, k) - one(leaves, k)).alias(f"w{k}") for k in range(words)])
            fewer = F.when(leaves > 0, f(F.greatest(n_out - 1, F.lit(0))) - f(n_out)).otherwise(F.lit(0.0))
            stretches = [F.when(enters <= m, acc[f"s_{c}"] + 1).otherwise(F.lit(0)).alias(f"s_{c}") for c, m, _ in CLASSES]
            return F.struct(counts.alias("counts"), (acc["total"] + fewer + f(n_in + 1) - f(n_in)).alias("total"), *stretches, *[acc[f"b_{c}"].alias(f"b_{c}") for c, _, _ in CLASSES])

        def step(acc: Column, at: Column) -> Column:
            pair = F.struct(F.element_at(codes, at).alias("enters"), F.when(at > window, F.element_at(codes, F.greatest(at - window, F.lit(1)))).otherwise(F.lit(0)).alias("leaves"))

            def best(now: Column) -> Column:
                entropy = F.lit(log2(window)) - now["total"] / float(window)
                tops = [F.greatest(now[f"b_{c}"], F.when(now[f"s_{c}"] >= window, entropy).otherwise(F.lit(-1.0))).alias(f"b_{c}") for c, _, _ in CLASSES]
                return F.struct(now["counts"].alias("counts"), now["total"].alias("total"), *[now[f"s_{c}"].alias(f"s_{c}") for c, _, _ in CLASSES], *tops)

            return with_value(pair, lambda x: with_value(moved(acc, x), best))

        start = F.struct(
            F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in range(words)]).alias("counts"), F.lit(0.0).alias("total"),
            *[F.lit(0).alias(f"s_{c}") for c, _, _ in CLASSES], *[F.lit(-1.0).alias(f"b_{c}") for c, _, _ in CLASSES],
        )

        def named(acc: Column) -> Column:
            kind = F.lit(None).cast("string")
            for name, _, bits in reversed(CLASSES):
                kind = F.when(acc[f"b_{name}"] > bits, F.lit(f"entropy_{name}")).otherwise(kind)
            return kind

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, named)

    return with_value(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c)), judged)


def entropy_spans(text: Column) -> Column:
    def of_gap(gap: Column, start: Column) -> Column:
        looks = F.filter(
            spans_of(gap, CANDIDATE, start),
            lambda s: s["found"].rlike(MIXED) & ~((F.length(s["found"]) <= ALLOW_RUN) & s["found"].rlike("|".join(f"(?:{p})" for p in ALLOWED))),
        )
        judged = F.transform(
            looks, lambda s: F.struct(s["start"], F.lit(len(BASE)).alias("rank"), window_kind(s["found"]).alias("kind"), s["end"])
        )
        return F.when(gap.rlike(CANDIDATE), F.filter(judged.cast(SPAN), lambda s: s["kind"].isNotNull())).otherwise(F.array().cast(SPAN))

    def between(matches: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(matches, lambda m: m["end"]))
        return F.flatten(F.zip_with(F.split(text, ANY_BASE, -1), starts, of_gap))

    cut = F.when(text.rlike(ANY_BASE), with_value(spans_of(text, ANY_BASE), between)).otherwise(of_gap(text, F.lit(0)))
    # most documents have no candidate: a cheap test first
    return F.when(text.rlike(CANDIDATE), cut).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, found: sorted arrays of (start, rank, kind, end) for every row of docs."""
    read = docs.select("doc_id", text_of().alias("body"))
    based = read.withColumn("base", base_spans(F.col("body")))
    return based.select(
        "doc_id", "base", F.array_sort(F.concat("base", entropy_spans(F.col("body")))).alias("found")
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(docs).select(
        "doc_id",
        *[count(kind) for kind, _, _ in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )

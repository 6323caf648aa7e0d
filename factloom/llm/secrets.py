"""Secret scans, native: fixed formats and a battery of randomness tests, in DataFrame expressions only.

Base spans: three formats (see BASE); leftmost, not overlapping, those too short dropped.

Random spans: a token is a run of TOKEN characters that overlaps no base span. Its encoding is inferred from its alphabet:
hex, base32, else base64 (either variant). Under the hypothesis that its symbols are drawn evenly from that alphabet, three
statistics are normal about: chi-squared of the symbols' cells (by Wilson and Hilferty's cube root; too even counts as
even), the number of runs above and below the alphabet's middle, and the serial correlation of neighbours. Their sum of
squares gives one p-value: natural strings fall near 0, random ones anywhere.

False-discovery control: over all documents, distinct tokens are counted by encoding, length class and p-value. In each
class those above 1/2 are taken to be half of the random ones, which tells how many random tokens stand above any other cut;
the rest are natural. Natural tokens also leak above 1/2, where that count cannot tell them: natural ones are counted in the
decades of p from 0.001 to 0.01 and from 0.01 to 0.1, and are taken to thin out at the same rate (not to grow) from 0.1 to 1.
The lowest cut at which the larger of both estimates is at most MAX_FALSE of what stands above is the class's cut; a class
without such a cut reports nothing. Those below 0.001, where one of a thousand random tokens falls, must also pass by
themselves to be reported. How many natural tokens a class has otherwise does not matter. The counts are a bounded
table.

Spans are KIND:START:END, code points, end exclusive, by start, then kind in the order of KINDS.

Texts are read once: spans, and of each token its statistics and digest, are written to the shared folder, and cuts and
results come from there. Sums and overlaps along a text's spans are folded in blocks, so that a text of very many spans
takes time in proportion to them.

Defined cases: null or empty text has no spans; repeated rows count and return as rows of their own; a very long text, or a
text of one token, is scanned whole; spans of one start go by kind; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: Kind, pattern, group whose length counts, least length.
BASE = (("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
KINDS = (*(k for k, *_ in BASE), "random")
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
HEX_SYMBOLS, BASE32, BASE64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MAX_FALSE, BINS, DECADES = 0.05, 20, 4
#: Upper ends of the length classes; the last is open.
LENGTHS = (24, 32, 48, 64, 128)
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Elements that are folded one by one; a longer array is folded block by block.
FOLD = 256
_FAR = (1 << 31) - 1


def bound(value: Column, body) -> Column:
    """body(value), with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, zero: int) -> Column:
    """For each element, zero and all elements before it under op (ints). An array grows by copies only inside a block."""

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(blocks: Column) -> Column:
        ahead = fold(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, ahead, lambda b, a: F.transform(b["out"], lambda x: op(a, x))))

    def whole(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / FOLD).cast("int")
        return bound(F.transform(F.sequence(F.lit(0), last), lambda b: fold(F.slice(v, b * FOLD + 1, FOLD))), joined)

    return bound(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, look: str | None = None, with_token: bool = False) -> Column:
    """Spans of a pattern's matches: what lies between the matches gives their places. look: a cheaper pattern that any match contains."""
    match, measured = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    none = F.array().cast(_SPAN.replace("end:int", "end:int,token:string") if with_token else _SPAN)

    def walk(m: Column) -> Column:
        gaps = F.transform(F.slice(m["gaps"], 1, F.size(m["match"])), F.length)
        sizes = F.transform(m["match"], F.length)
        places = F.struct(gaps.alias("gaps"), sizes.alias("sizes"))
        return bound(places, lambda p: bound(running(F.zip_with(p["gaps"], p["sizes"], lambda g, n: g + n), lambda a, b: a + b, 0), lambda at: placed(m, p, at)))

    def placed(m: Column, p: Column, at: Column) -> Column:
        def span(token: Column, i: Column) -> Column:
            start = F.get(at, i) + F.get(p["gaps"], i)
            found = [start.alias("start"), F.lit(kind).alias("kind"), (start + F.get(p["sizes"], i)).alias("end")]
            return F.struct(*found, token.alias("token")) if with_token else F.struct(*found)

        spans = F.transform(m["match"], span)
        return F.filter(spans, lambda _, i: F.length(F.get(m["measured"], i)) >= least) if least else spans

    parts = [match.alias("match"), F.split(text, pattern, -1).alias("gaps"), *([measured.alias("measured")] if least else [])]
    return F.when(text.rlike(look or pattern), bound(F.struct(*parts), walk)).otherwise(none)  # a look first: most texts have none


def apart(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap no span. Both are sorted by start together: no span before a token ends behind its start, and the next one begins at its end or later."""
    with_place = lambda xs: F.transform(xs, lambda s, i: F.struct(s["start"], s["kind"], s["end"], i.alias("i")))
    is_span = lambda e: e["kind"] < len(BASE)

    def kept(every: Column) -> Column:
        ends = F.transform(every, lambda e: F.when(is_span(e), e["end"]).otherwise(F.lit(0)))
        starts = F.transform(F.reverse(every), lambda e: F.when(is_span(e), e["start"]).otherwise(F.lit(_FAR)))
        around = F.struct(running(ends, F.greatest, 0).alias("before"), F.reverse(running(starts, F.least, _FAR)).alias("after"))
        free = lambda a: F.filter(every, lambda e, i: ~is_span(e) & (F.get(a["before"], i) <= e["start"]) & (F.get(a["after"], i) >= e["end"]))
        return bound(around, lambda a: F.transform(free(a), lambda e: F.get(tokens, e["i"])))

    return bound(F.array_sort(F.concat(with_place(spans), with_place(tokens))), kept)


def encoding(token: Column) -> Column:
    """0 hex, 1 base32, 2 base64."""
    return F.when(token.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z"), F.lit(0)).when(token.rlike(r"\A[A-Z2-7]+\z"), F.lit(1)).otherwise(F.lit(2))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def p_value(token: Column) -> Column:
    """Probability that evenly drawn symbols look as uneven as the token."""
    return bound(F.struct(token.alias("token"), encoding(token).alias("e")), _p_value)


def _p_value(t: Column) -> Column:
    plain = F.when(t["e"] == 0, F.lower(t["token"])).otherwise(F.translate(t["token"], "-_", "+/"))
    alphabet = F.get(F.array(F.lit(HEX_SYMBOLS), F.lit(BASE32), F.lit(BASE64)), t["e"])
    inputs = F.struct(F.split(plain, "").alias("chars"), alphabet.alias("alphabet"), F.length(alphabet).cast("double").alias("k"), F.when(t["e"] == 0, F.lit(16)).otherwise(F.lit(8)).alias("cells"))
    return bound(inputs, lambda x: bound(_symbols(x), _battery))


def _symbols(x: Column) -> Column:
    symbols = F.transform(x["chars"], lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
    return F.struct(symbols.alias("symbols"), x["k"].alias("k"), x["cells"].alias("cells"), F.size(x["chars"]).cast("double").alias("n"))


def _battery(x: Column) -> Column:
    n, cells = x["n"], x["cells"]
    places = F.sequence(F.lit(0), F.size(x["symbols"]) - 2)

    def count_of(cell: Column) -> Column:
        return F.size(F.filter(x["symbols"], lambda s: F.floor(s * cells / x["k"]) == cell)).cast("double")

    squares = _total(F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.pow(count_of(c), F.lit(2.0))))
    df = (cells - 1).cast("double")
    spread = F.lit(2.0) / (F.lit(9.0) * df)
    cube = F.pow(F.greatest(cells / n * squares - n, F.lit(0.0)) / df, F.lit(1 / 3))
    z_chi = F.greatest((cube - (F.lit(1.0) - spread)) / F.sqrt(spread), F.lit(0.0))

    half = x["k"] / 2
    n1 = F.size(F.filter(x["symbols"], lambda s: s >= half)).cast("double")
    runs = F.size(F.filter(places, lambda i: (F.get(x["symbols"], i) >= half) != (F.get(x["symbols"], i + 1) >= half))).cast("double") + 1
    about = F.struct(n1.alias("n1"), runs.alias("runs"), (_total(x["symbols"]) / n).alias("mean"), z_chi.alias("z_chi"))

    def combined(y: Column) -> Column:
        expected = F.lit(2.0) * y["n1"] * (n - y["n1"]) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when(variance > 0, (y["runs"] - expected) / F.sqrt(variance)).otherwise(F.lit(0.0))
        power = _total(F.transform(x["symbols"], lambda s: F.pow(s - y["mean"], F.lit(2.0))))
        lagged = _total(F.transform(places, lambda i: (F.get(x["symbols"], i) - y["mean"]) * (F.get(x["symbols"], i + 1) - y["mean"])))
        z_serial = F.when(power > 0, (lagged / power + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        return (F.pow(y["z_chi"], F.lit(2.0)) + F.pow(z_runs, F.lit(2.0)) + F.pow(z_serial, F.lit(2.0))) / 3

    z = bound(about, lambda y: (F.pow(combined(y), F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5)
    # The normal tail by its logistic form (within 0.0002).
    return bound(z, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * v + F.lit(0.07056) * v * v * v)))


def length_class(token: Column) -> Column:
    found = F.lit(len(LENGTHS))
    for i, end in reversed(list(enumerate(LENGTHS))):
        found = F.when(F.length(token) < end, F.lit(i)).otherwise(found)
    return found


def base_spans(text: Column) -> Column:
    looks = {"hex": HEX[:-1] + "{24}"}
    return F.concat(*(spans_of(text, pattern, i, group, least, looks.get(kind)) for i, (kind, pattern, group, least) in enumerate(BASE)))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, base (start, kind, end), and tokens (also e, c, p, digest): those that overlap no base span."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), spans_of(F.col("text"), TOKEN, len(BASE), with_token=True).alias("every"))
    free = F.when((F.size("every") > 0) & (F.size("base") > 0), apart(F.col("every"), F.col("base"))).otherwise(F.col("every"))

    def told(t: Column) -> Column:
        token = t["token"]
        return F.struct(t["start"], t["kind"], t["end"], encoding(token).alias("e"), length_class(token).alias("c"), p_value(token).alias("p"), F.md5(token.cast("binary")).alias("digest"))

    return found.select("doc_id", "base", free.alias("tokens")).select("doc_id", "base", F.transform("tokens", told).alias("tokens"))


def cuts(rows: DataFrame, max_false: float = MAX_FALSE) -> dict[tuple[int, int], float]:
    """rows: of with_spans(). The least p-value of each encoding and length class that counts as random; classes that report nothing are left out."""
    scored = rows.select(F.explode("tokens").alias("t")).select("t.e", "t.c", "t.p", "t.digest")
    p, decade = F.col("p"), F.lit(DECADES - 1)
    for i in reversed(range(DECADES - 1)):
        decade = F.when(p >= 0.1 ** (i + 1), F.lit(i)).otherwise(decade)
    distinct = scored.select("e", "c", F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), decade.alias("decade"), "digest").distinct()
    bins: dict[tuple[int, int], list[int]] = {}
    decades: dict[tuple[int, int], list[int]] = {}
    for r in distinct.groupBy("e", "c", "bin", "decade").agg(F.count("*").alias("n")).collect():  # encodings * classes * (bins + decades) rows
        bins.setdefault((r["e"], r["c"]), [0] * BINS)[r["bin"]] += r["n"]
        decades.setdefault((r["e"], r["c"]), [0] * DECADES)[r["decade"]] += r["n"]
    return {key: cut for key, n in bins.items() if (cut := _cut(n, decades[key], max_false)) is not None}


def _leak(decades: list[int], random: int):
    """A function from a cut to the natural tokens above it: those from 0.1 to 1 continue the two decades below."""
    last, before = (max(0.0, decades[i] - random * 0.9 * 0.1**i) for i in (1, 2))
    rate = min(1.0, last / before) if before else 1.0

    def above(cut: float) -> float:
        t = max(0.0, math.log10(cut) + 1) if cut else 0.0
        return last * rate * (1 - t if rate == 1 else (rate**t - rate) / (1 - rate))

    return above


def _cut(bins: list[int], decades: list[int], max_false: float) -> float | None:
    """bins: distinct tokens by p-value, in equal bins; decades: the same tokens by decade, from 0.1 to 1 first."""
    random = 2 * sum(bins[BINS // 2 :])
    leak = _leak(decades, random)
    total, lowest, least = sum(bins), decades[-1], 0.1 ** (DECADES - 1)
    above = {0.0: total, least: total - lowest, **{i / BINS: sum(bins[i:]) for i in range(1, BINS)}}
    for cut, n in above.items():
        if cut == 0 and lowest - random * least > max_false * lowest:
            continue  # the lowest decade holds more than random tokens would
        if n and max(n - random * (1 - cut), leak(cut)) <= max_false * n:
            return cut
    return None


def scan(docs: DataFrame, max_false: float = MAX_FALSE) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    rows = stored(with_spans(docs), "secret-tokens")
    found = cuts(rows, max_false)
    classes = len(LENGTHS) + 1
    levels = F.array(*(F.lit(found.get((e, c), 2.0)) for e in range(3) for c in range(classes)))
    random = F.filter("tokens", lambda t: t["p"] >= F.get(levels, t["e"] * classes + t["c"]))
    rows = rows.withColumn("random", F.transform(random, lambda t: F.struct(t["start"], t["kind"], t["end"])).cast(_SPAN))
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)),
        F.size("random").cast("long").alias("n_random"),
        F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        said(F.concat("base", "random")).alias("spans"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))

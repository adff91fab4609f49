"""Secret scans: fixed patterns, and two character Markov models compared by likelihood ratio.

Base kinds are found by pattern, leftmost and non-overlapping within a kind. What lies outside
them is searched for runs of token characters; a run is a secret when the model of random
strings gives it a likelihood that exceeds the model of ordinary text by `MIN_TOTAL`
nats in all and `MIN_MEAN` a character. Where the whole run fails, as in NAME=value and in paths
and prefixes, its parts are tried: the running sum of the ratio less `MIN_MEAN` a character
begins again below zero, and a part ends where the sum has fallen by `MIN_GAIN` from its maximum;
parts that rise by less are ordinary. Parts lose what lies beyond a separator in the `EDGE` characters
at their ends, then grow to the `SEPARATORS` around them; parts that meet are one, and a secret
has `MIN_TOTAL` nats. Runs of `MIN_RUN` characters and more are looked at, and the thresholds alone decide on them: of random letters and digits they
take 17 in 100 strings of 8 characters, 50 of 10, 77 of 12 and 91 of 14; even rarer pairs would be needed in shorter ones. Both models are bigram tables with add-half
smoothing over ASCII, trained by aggregation from labelled samples (`text`, `secret`): some made by
rule (`labelled_samples`), and tokens of a bounded, hashed sample of the table's own documents, the
matches of the fixed patterns as secrets and runs of token characters below `TAUGHT` characters, nearly all of them words, as ordinary
(`document_samples`). No set weighs more than `SET_PAIRS` pairs. Positions are code points, end exclusive.

Everything is built-in functions on one row, with no shuffle but that of the samples; the model is
a literal of 128 x 128 numbers. Work grows in proportion to a text's length, however many matches
it has. Null text is empty. Repeated rows stay; an empty table gives an empty one and adds nothing to the
samples. Columns of any names pass through `redact`; `scan` reads the named ones only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm.quality import let

#: Fixed by the contract: kind, pattern, least length, group that the length is of.
KINDS = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),
)
RANDOM = "random"
MIN_RUN = 8
#: A whole run: only its first character has none of its kind before it, so no other is tried.
RUN = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{MIN_RUN},}}+"
SEPARATORS = "/=_-"
EDGE = 4
BASE = rf"(?:{KINDS[0][1]})|AKIA[A-Z0-9]{{16,}}|{KINDS[2][1]}"
MIN_TOTAL = 16.0
MIN_MEAN = 0.6
MIN_GAIN = 8.0
SAMPLES = 3000
#: Bounds of the sample of documents: rows, and characters of each that teach.
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARS = 20_000
#: Tokens of documents teach as ordinary below this length, and matches of the fixed patterns as random from it on.
TAUGHT = 14
#: A set of samples counts as so many pairs in each class at most.
SET_PAIRS = 100_000.0
#: Items of a chunk of `running`.
CHUNK = 256
#: Ordinary parts of identifiers.
PARTS = (
    "account address array average base batch block buffer build byte cache call channel child class client close code column config connection content "
    "context control copy count create current data date default delete depth document domain element encode entry error event factory field file filter "
    "first float format frame function get global group handler hash header height host image import index info input instance item iterator job key label "
    "language last layer length level library line link list load local lock log manager map match max memory message method min mode model module name "
    "network next node number object offset open operation option order output owner page parent parser partition path pattern pixel pool position prefix "
    "process profile property query queue random range read record reference region register remove render request reset resource response result return "
    "root row rule run sample schema scope score search section segment select sequence server service session set shape size sort source span stack start "
    "state status stream string style suffix summary switch system table target task template test text thread time title total transform tree type union "
    "unit update upper user utility valid value vector version view visible width window worker write with from into that this have been their which"
).split()


def labelled_samples(spark: SparkSession, rows: int = SAMPLES) -> DataFrame:
    """text, secret: seeded random strings (hexadecimal, base64, upper-case and digits) and identifiers in four styles of writing."""
    parts = F.expr("split('" + " ".join(PARTS) + "', ' ')")
    pick = lambda k: F.get(parts, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")).cast("binary"), 256)
    plain = F.base64(F.unhex(digest))
    random = F.element_at(F.array(digest, plain, plain, F.translate(plain, "+/=", "-_"), F.upper(F.translate(plain, "+/=", "")), F.lower(F.translate(plain, "+/=", ""))), (F.col("id") % 6 + 1).cast("int"))
    many = F.transform(F.sequence(F.lit(1), F.lit(4)), pick)
    ordinary = F.element_at(F.array(F.array_join(many, "_"), F.array_join(many, "-"), F.array_join(F.transform(many, F.initcap), ""), F.upper(F.array_join(many, "_")), F.array_join(many, ""), F.array_join(many, "/"), F.concat(F.array_join(many, "_"), (F.col("id") % 100).cast("string"))), (F.col("id") % 7 + 1).cast("int"))
    ids = spark.range(rows)
    return ids.select(random.alias("text"), F.lit(True).alias("secret")).unionByName(ids.select(ordinary.alias("text"), F.lit(False).alias("secret")))


def codes(s: Column) -> Column:
    """ASCII codes of a string's characters."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), F.ascii)


def pairs(c: Column) -> Column:
    """code * 128 + next code, for all neighbours."""
    return F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: a * 128 + b)


def document_samples(df: DataFrame, text: str = "text", rows: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """text, secret: tokens of about `rows` distinct texts, those with the least hashes.

    Matches of the fixed patterns are secrets where they have TAUGHT characters or more. Other runs teach what is
    ordinary where they have fewer, so that a long secret in the sample teaches nothing; short ones are rare among its words.
    """
    hashed = df.select(F.substring(F.col(text).cast("string"), 1, SAMPLE_CHARS).alias("t"), F.xxhash64(F.lit(5), F.col(text).cast("string")).alias("h")).where("t IS NOT NULL")
    n = df.count()
    some = hashed.where(F.col("h") <= F.lit(min((1 << 63) - 1, int(rows / max(1, n) * (1 << 64)) - (1 << 63)))).groupBy("h").agg(F.min("t").alias("t"))
    found = lambda pattern, group: F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
    long = F.filter(F.flatten(F.array(*(found(p, g) for _, p, _, g in KINDS))), lambda x: F.length(x) >= TAUGHT)
    plain = F.filter(F.regexp_extract_all(F.regexp_replace("t", BASE, " "), F.lit(r"[A-Za-z0-9+/=_-]{4,}"), F.lit(0)), lambda x: F.length(x) < TAUGHT)
    return some.select(F.inline(F.concat(F.transform(long, lambda x: F.struct(x.alias("text"), F.lit(True).alias("secret"))), F.transform(plain, lambda x: F.struct(x.alias("text"), F.lit(False).alias("secret"))))))


def train(*sets: DataFrame) -> list[float]:
    """ln(P(next | character, random) / P(next | character, ordinary)), at code * 128 + next code. The counts, at most 2 x 128 x 128 a set, come to the driver."""
    counts: dict[tuple[bool, int], float] = {}
    for samples in sets:
        ascii_only = samples.where(F.col("text").rlike(r"^[\x21-\x7E]{2,}$"))
        each = ascii_only.select("secret", F.explode(let(codes(F.col("text")), pairs)).alias("pair"))
        found = each.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()
        for secret in (True, False):
            total = sum(r["n"] for r in found if r["secret"] == secret)
            for r in found:
                if r["secret"] == secret:
                    counts[secret, r["pair"]] = counts.get((secret, r["pair"]), 0.0) + r["n"] * min(1.0, SET_PAIRS / total)
    seen = range(33, 127)
    out = [0.0] * (128 * 128)
    for a in seen:
        of = {s: sum(counts.get((s, a * 128 + b), 0) for b in seen) + 0.5 * len(seen) for s in (True, False)}
        for b in seen:
            out[a * 128 + b] = math.log((counts.get((True, a * 128 + b), 0) + 0.5) / of[True]) - math.log((counts.get((False, a * 128 + b), 0) + 0.5) / of[False])
    return out


def default_model(df: DataFrame, text: str = "text") -> list[float]:
    """Trained from samples made by rule and from the table's own documents."""
    return train(labelled_samples(df.sparkSession), document_samples(df, text))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """combine over each item and all before it; combine is associative, zero its neutral element.

    An accumulator that grows costs its square, so items go in chunks that begin with the running
    results of the chunks' totals.
    """

    def scan(items: Column, first: Column) -> Column:
        """`first`, then the running results."""
        return F.aggregate(items, F.array(first), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def of(parts: Column) -> Column:
        starts = scan(F.transform(parts, lambda c: F.aggregate(c, zero, combine)), zero)
        return let(starts, lambda s: F.flatten(F.transform(parts, lambda c, k: F.slice(scan(c, F.get(s, k)), 2, CHUNK))))

    return let(values, lambda v: let(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK))), of))


NONE = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, pattern: str, rank: int, least: int, group: int) -> Column:
    """start, rank, end of the matches of a pattern, from what it splits the text into and what it extracts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # the piece after the last match has none
    lengths = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("n"), F.transform(value, F.length).alias("v"))

    def of(zipped: Column) -> Column:
        ends = running(F.transform(zipped, lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))), lambda a, b: a + b, F.lit(0))
        spans = F.zip_with(zipped, ends, lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["v"].alias("v")))
        return F.transform(F.filter(spans, lambda x: F.coalesce(x["v"], F.lit(-1)) >= least), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    return F.when(text.rlike(pattern), let(lengths, of)).otherwise(F.array().cast(NONE))


PARTS_KIND = "array<struct<start:int,end:int,total:double>>"


def _high_parts(ratios: Column) -> Column:
    """start, end, total of the parts in which the sum of the ratios less MIN_MEAN rises by MIN_GAIN, in characters of the run."""
    closed = lambda acc: F.struct(acc["start"].alias("start"), acc["end"].alias("end"), (acc["max"] + (acc["end"] - acc["start"] - 1) * MIN_MEAN).alias("total"))
    kept = lambda acc: F.concat(acc["out"], F.array(closed(acc)))

    def state(at: Column, total: Column, most: Column, start: Column, end: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), total.alias("sum"), most.alias("max"), start.alias("start"), end.alias("end"), out.alias("out"))

    def step(acc: Column, r: Column) -> Column:
        at = acc["at"] + 1

        def moved(total: Column) -> Column:
            ends = (acc["max"] >= MIN_GAIN) & (total <= acc["max"] - MIN_GAIN)
            again = state(at, F.lit(0.0), F.lit(0.0), at, at, F.when(ends, kept(acc)).otherwise(acc["out"]))
            on = state(at, total, F.greatest(acc["max"], total), acc["start"], F.when(total > acc["max"], at + 1).otherwise(acc["end"]), acc["out"])
            return F.when(ends | (total < 0), again).otherwise(on)

        return let(acc["sum"] + r - MIN_MEAN, moved)

    none = F.array().cast(PARTS_KIND)
    begun = state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), none)
    return F.aggregate(ratios, begun, step, lambda acc: F.when(acc["max"] >= MIN_GAIN, kept(acc)).otherwise(acc["out"]))


def _random_parts(run: Column, model: Column) -> Column:
    """start, end, total of what the models call random in a run: all of it, or parts between separators."""
    n = F.length(run)

    def grown(x: Column, marked: Column, back: Column) -> Column:
        """The part up to the separators around it, less what of a neighbour it has in EDGE characters at its ends."""
        at = lambda where, i: F.call_function("locate", F.lit("/"), where, i + 1)  # noqa: E731  one-based, 0 without
        cut = lambda where, i: let(at(where, i), lambda k: F.when((k > 0) & (k <= i + EDGE), k).otherwise(i))
        out = lambda where, i: let(at(where, i), lambda k: F.when(k > 0, k - 1).otherwise(n))
        start = n - out(back, n - cut(marked, x["start"]))
        return F.struct(start.alias("start"), out(marked, n - cut(back, n - x["end"])).alias("end"), x["total"].alias("total"))

    def joined(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), (last["total"] + x["total"]).alias("total"))
        return F.when(x["start"] <= last["end"] + 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    def parts(ratios: Column) -> Column:
        marked = F.translate(run, SEPARATORS, "/" * len(SEPARATORS))
        each = let(marked, lambda m: F.transform(_high_parts(ratios), lambda x: grown(x, m, F.reverse(m))))
        met = F.aggregate(each, F.array().cast(PARTS_KIND), joined)
        return F.filter(met, lambda x: (x["total"] >= MIN_TOTAL) & (x["end"] - x["start"] >= MIN_RUN))

    def of(ratios: Column) -> Column:
        begun = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("most"))
        sums = F.aggregate(ratios, begun, lambda a, x: F.struct((a["total"] + x).alias("total"), (a["most"] + F.greatest(x, F.lit(0.0))).alias("most")))
        whole = lambda x: F.array(F.struct(F.lit(0).alias("start"), n.alias("end"), x.alias("total")))
        # no part has more than the sum of what is above zero
        return let(sums, lambda x: F.when(x["most"] < MIN_TOTAL, F.array().cast(PARTS_KIND)).when((x["total"] >= MIN_TOTAL) & (x["total"] >= MIN_MEAN * n), whole(x["total"])).otherwise(parts(ratios)))

    return let(F.transform(pairs(codes(run)), lambda i: F.get(model, i)), of)


def _gaps(text: Column) -> Column:
    """at, gap: what lies between base matches, where it has a run."""
    pieces = F.arrays_zip(F.split(text, BASE, -1).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(BASE), F.lit(0)), F.length).alias("n"))

    def of(zipped: Column) -> Column:
        ends = running(F.transform(zipped, lambda x: F.length(x["gap"]) + F.coalesce(x["n"], F.lit(0))), lambda a, b: a + b, F.lit(0))
        at = F.zip_with(zipped, ends, lambda x, end: F.struct((end - F.coalesce(x["n"], F.lit(0)) - F.length(x["gap"])).alias("at"), x["gap"].alias("gap")))
        return F.filter(at, lambda x: x["gap"].rlike(RUN))

    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("gap")))
    return F.when(~text.rlike(RUN), F.array().cast("array<struct<at:int,gap:string>>")).when(~text.rlike(BASE), whole).otherwise(let(pieces, of))


def _runs(gaps: Column) -> Column:
    """at, run: the runs of the gaps."""

    def of(gap: Column, at: Column) -> Column:
        def placed(found: Column) -> Column:
            before = F.slice(F.transform(F.split(gap, RUN, -1), F.length), F.lit(1), F.size(found))
            ends = running(F.zip_with(before, found, lambda n, r: n + F.length(r)), lambda a, b: a + b, F.lit(0))
            return F.zip_with(found, ends, lambda r, end: F.struct((at + end - F.length(r)).alias("at"), r.alias("run")))

        return let(F.regexp_extract_all(gap, F.lit(RUN), F.lit(0)), placed)

    return F.flatten(F.transform(gaps, lambda g: of(g["gap"], g["at"])))


def _random_spans(runs: Column, model: Column) -> Column:
    """What of the runs the models call random."""
    spans = lambda x: F.transform(_random_parts(x["run"], model), lambda p: F.struct((x["at"] + p["start"]).alias("start"), F.lit(len(KINDS)).alias("rank"), (x["at"] + p["end"]).alias("end")))
    return F.flatten(F.transform(runs, spans))


def _apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of `base`: in one order by place, no base span that begins before a span's end reaches over its start."""
    event = lambda at, kind, reach, start, end: F.struct(at.alias("at"), kind.alias("kind"), reach.alias("reach"), start.alias("start"), end.alias("end"))
    bases = F.transform(base, lambda b: event(b["start"], F.lit(1), b["end"], b["start"], b["end"]))
    own = F.transform(spans, lambda x: event(x["end"], F.lit(0), F.lit(-1), x["start"], x["end"]))

    def of(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b), F.lit(-1))
        kept = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e["kind"].alias("kind"), (r <= e["start"]).alias("free"), e["start"].alias("start"), e["end"].alias("end"))), lambda x: (x["kind"] == 0) & x["free"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end")))

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(let(F.array_sort(F.concat(bases, own)), of))


def model_literal(model: list[float]) -> Column:
    return F.expr("split('" + " ".join(f"{x:.4f}" for x in model) + "', ' ')").cast("array<double>")


def with_spans(df: DataFrame, text: str = "text", model: list[float] | None = None) -> DataFrame:
    """row: df's columns; body: the text, empty for null; base and spans: arrays of (start, rank, end), by start and rank."""
    model = default_model(df, text) if model is None else model
    named = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    base = F.array_sort(F.concat(*(_spans(F.col("body"), p, i, least, group) for i, (_, p, least, group) in enumerate(KINDS))))
    found = named.withColumn("base", base).withColumn("gaps", _gaps(F.col("body"))).withColumn("runs", _runs(F.col("gaps")))
    found = found.withColumn("random", _random_spans(F.col("runs"), model_literal(model))).withColumn("random", _apart(F.col("random"), F.col("base")))
    return found.select("row", "body", "base", F.array_sort(F.concat("base", "random")).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k, *_ in KINDS), F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", model: list[float] | None = None) -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("bigint")
    found = with_spans(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", model)
    return found.select(F.col("row.key").alias(key), *(of(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)), F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), of(len(KINDS)).alias("n_random"))


def _pieces(body: Column, intervals: Column, sizes: tuple[int, ...] = (CHUNK * CHUNK, CHUNK)) -> Column:
    """The characters of each interval (a, z), which are in order. A substring walks from its string's beginning, so neighbours are taken out of a common piece."""
    if not sizes:
        return F.transform(intervals, lambda x: body.substr(x["a"] + 1, x["z"] - x["a"]))
    n = sizes[0]
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(intervals) - 1) / n).cast("int")), lambda k: F.slice(intervals, k * n + 1, F.lit(n)))

    def of(g: Column) -> Column:
        first, last = F.get(g, F.lit(0))["a"], F.element_at(g, -1)["z"]
        moved = F.transform(g, lambda x: F.struct((x["a"] - first).alias("a"), (x["z"] - first).alias("z")))
        return let(F.struct(body.substr(first + 1, last - first).alias("body"), moved.alias("moved")), lambda x: _pieces(x["body"], x["moved"], sizes[1:]))

    return F.when(F.size(intervals) <= n, _pieces(body, intervals, sizes[1:])).otherwise(F.flatten(F.transform(groups, of)))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """df with every secret of `text` replaced by a mark; spans that overlap or meet by one. Null text stays null."""
    found = with_spans(df, text, model)

    def clean(spans: Column) -> Column:
        # a marked place begins where no earlier span reaches, and ends with the next such place's reach so far
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(-1))
        before = F.concat(F.array(F.lit(-1)), F.slice(reach, 1, F.size(reach) - 1))
        each = F.arrays_zip(spans.alias("s"), before.alias("b"), reach.alias("r"))
        first = F.filter(each, lambda x: x["s"]["start"] > x["b"])
        ends = lambda f: F.transform(f, lambda x, i: F.struct(x["s"]["start"].alias("a"), F.coalesce(F.get(f, i + 1)["b"], F.array_max(reach)).alias("z")))
        return let(first, ends)

    def ordinary(places: Column) -> Column:
        """The intervals outside the places, in order."""
        return F.transform(F.concat(F.array(F.lit(0)), places["z"]), lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(places, i)["a"], F.length("body")).alias("z")))

    redacted = let(let(F.col("spans"), clean), lambda places: F.array_join(let(ordinary(places), lambda x: _pieces(F.col("body"), x)), mark))
    changed = F.when(F.size("spans") > 0, redacted).otherwise(F.col(f"row.`{text}`"))
    return found.select(*(changed.alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns))

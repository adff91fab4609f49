"""Questionnaires and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield.functions import text as T
from loomfield.model import ALIASES
from loomfield.operators.skew import carried, in_intervals, running_last, summaries


# Fixed value: the sheet that holds a workbook's questions.
SHEET = "2. Questionnaire"


def of_cells(cells: DataFrame, sheet: str = SHEET) -> DataFrame:
    """workbook, row_idx, and the known columns (question_no, theme, question, targets, response, topic) of a sheet's rows below its header: the first row with two known names or more. Rows without a question are left out."""
    names = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    value = F.coalesce("formula", "text")
    own = cells.where((F.col("sheet") == sheet) & (F.col("kind") != "BLANK")).select("workbook", "row_idx", "col_idx", F.trim(value).alias("value"))
    named = own.withColumn("name", names[F.col("value")]).where("name IS NOT NULL")
    heads = named.groupBy("workbook", "row_idx").agg(F.count_distinct("name").alias("n")).where("n >= 2").groupBy("workbook").agg(F.min("row_idx").alias("header_row"))
    columns = named.join(heads, "workbook").where("row_idx = header_row").select("workbook", "header_row", "col_idx", "name")
    found = own.join(columns, ["workbook", "col_idx"]).where("row_idx > header_row")
    each = sorted({*ALIASES.values()})
    rows = found.groupBy("workbook", "row_idx").agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in each))
    return rows.where("question IS NOT NULL").select("workbook", "row_idx", *each)


def targets(questions: DataFrame, column: str = "targets") -> DataFrame:
    """One row per target, with its place in the cell."""
    return questions.select(*(c for c in questions.columns if c != column), F.posexplode(T.values_of(F.col(column))).alias("target_no", "target"))


def target_counts(questions: DataFrame, column: str = "targets") -> DataFrame:
    return questions.withColumn("n_targets", F.size(T.values_of(F.col(column))))


def outside_domain(rows: DataFrame, lookup: DataFrame, column: str) -> DataFrame:
    """Rows whose value the list doesn't have."""
    return rows.join(lookup.select(F.col(column).alias("__d")).distinct(), F.col(column) == F.col("__d"), "left_anti")


def answers(questions: DataFrame, responses: DataFrame) -> DataFrame:
    """Every question with its answers; unanswered ones stay."""
    return questions.join(responses, "question_no", "left")


def reply_pairs(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user turn with the assistant turn that follows directly. Hot conversations are cut by order, and an interval's last turn gets the next one's first."""
    cut, any_hot = in_intervals(turns, [conversation], order)
    w = Window.partitionBy(conversation, "__b").orderBy(order)
    rows = cut.withColumn("__next", F.lead(F.struct("role", "text")).over(w))
    if any_hot:
        first = summaries(cut, [conversation], F.min_by(F.struct("role", "text"), F.struct(order)).alias("__first"))
        onward = first.select(conversation, "__b", F.lead("__first").over(Window.partitionBy(conversation).orderBy("__b")).alias("__onward"))
        rows = carried(rows, [conversation], onward).withColumn("__next", F.coalesce("__next", "__onward"))
    return rows.where("role = 'user'").select(conversation, order, F.col("text").alias("question"), F.when(F.col("__next.role") == "assistant", F.col("__next.text")).alias("reply"))


def fill_forward(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and including the row."""
    return running_last(rows, by, [order], value, name)


SEED_WORDS = 6
#: Bytes of short quotes, with BESIDES for each, that an automaton is made of at once.
BLOCK_BYTES = 8_000_000
BESIDES = 100
#: Pairs that a task gives at once.
AT_ONCE = 10_000


def evidence(texts: DataFrame, quotes: DataFrame, text: str, quote: str, text_key: str, quote_key: str) -> DataFrame:
    """(text_key, quote_key) where the text contains the quote verbatim, once each for a row of texts and one of quotes.

    An equi-join on a hash of the quote's first words finds the candidates, so no text meets every quote;
    `contains` decides. A quote of fewer than SEED_WORDS + 2 blanks-separated pieces has no seed
    that its neighbours can't alter: `short_evidence` finds those. Null texts and quotes match nothing; an empty quote is in every text.
    """
    parts = F.split(F.col(quote), " ")
    # the first piece may continue a word of the text, so the seed begins at the second
    seeded = quotes.withColumn("__n", F.size(parts)).withColumn("__seed", F.when(F.col("__n") >= SEED_WORDS + 2, F.xxhash64(F.slice(parts, 2, SEED_WORDS))))
    windows = T.let(F.split(F.col(text), " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SEED_WORDS + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SEED_WORDS))))
    seeds = texts.select(text_key, F.explode(F.array_distinct(windows)).alias("__seed"))
    hits = seeds.join(seeded.where("__seed IS NOT NULL").select(quote_key, quote, "__seed"), "__seed").select(text_key, quote_key, quote).distinct()
    long = hits.join(texts.select(text_key, text), text_key).where(F.contains(F.col(text), F.col(quote))).select(text_key, quote_key)
    return long.unionByName(short_evidence(texts, seeded.where("__seed IS NULL"), text, quote, text_key, quote_key))


def short_evidence(texts: DataFrame, quotes: DataFrame, text: str, quote: str, text_key: str, quote_key: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same by Aho-Corasick automata: each text is read once for a block of quotes, whatever their number and length.

    Quotes are dealt by hash into blocks of about `block_bytes`; the driver sends one block after
    another to the tasks, which hold the automaton of one. Texts aren't shuffled.
    """
    known = quotes.where(F.col(quote).isNotNull()).select(quote_key, F.col(quote).alias("__quote"))
    size = known.agg(F.sum(F.octet_length("__quote") + BESIDES)).first()[0]
    read = texts.where(F.col(text).isNotNull()).select(text_key, F.col(text).alias("__text"))
    kinds = (dict(texts.dtypes)[text_key], dict(quotes.dtypes)[quote_key])
    schema = f"`{text_key}` {kinds[0]}, `{quote_key}` {kinds[1]}"
    if not size:
        return texts.sparkSession.createDataFrame([], schema)
    blocks, spark = 1 + size // block_bytes, texts.sparkSession
    found = None
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("__quote"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast((rows.column(0).combine_chunks(), rows.column(1).to_pylist()))
        part = read.mapInArrow(_finder(sent, text_key, quote_key), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _finder(sent, text_key: str, quote_key: str):  # noqa: ANN001, ANN202
    """For mapInArrow: pairs of the batch's texts and the quotes sent."""

    def run(batches):  # noqa: ANN001, ANN202
        import ahocorasick
        import pyarrow as pa

        keys, quotes = sent.value
        places: dict[str, list[int]] = {}
        for i, q in enumerate(quotes):
            places.setdefault(q, []).append(i)
        everywhere = places.pop("", [])
        automaton = ahocorasick.Automaton()
        for q, i in places.items():
            automaton.add_word(q, i)
        automaton.make_automaton()

        def pairs(batch, at: list[int], which: list[int]):  # noqa: ANN001, ANN202
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), keys.take(pa.array(which, pa.int64()))], names=[text_key, quote_key])

        for batch in batches:
            at: list[int] = []
            which: list[int] = []
            for row, t in enumerate(batch.column(1)):
                hits = {id(i): i for _, i in automaton.iter(t.as_py())} if places else {}
                for i in (everywhere, *hits.values()):
                    at += [row] * len(i)
                    which += i
                if len(at) > AT_ONCE:
                    yield pairs(batch, at, which)
                    at, which = [], []
            yield pairs(batch, at, which)

    return run

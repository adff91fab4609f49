"""The query catalogue over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomfield import model
from loomfield.catalog import DIRTY_SQL, dirty, load
from loomfield.functions import text as T
from loomfield.operators import clean as C
from loomfield.operators import journey as J
from loomfield.operators import profile as P
from loomfield.operators import questionnaire as Q
from loomfield.operators import relational as R
from loomfield.operators import saturation as S
from loomfield.operators import scorecard as K
from loomfield.plans import report as REP
from loomfield.sources import markdown as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Order priorities stand in for numbered themes.
PRIORITIES = ("urgent", "high", "medium", "not specified", "low")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- saturation -----------------------------------------------------------------------------

OBS = "obs AS (SELECT DISTINCT user_id AS p, event_type || ':' || json_extract_string(props, '$.k') AS i FROM events), firsts AS (SELECT i, min(p) AS f FROM obs GROUP BY i)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand in for participants in order, event type and key for insights."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("participant_ord"), F.col("user_id").cast("string").alias("participant"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("insight"))


MENTIONS = "few AS (SELECT DISTINCT c_nationkey AS p, c_mktsegment || ':' || CAST(CAST(floor(c_acctbal / 500) AS INTEGER) AS VARCHAR) AS i FROM customer), ff AS (SELECT i, min(p) AS f FROM few GROUP BY i)"


@query(f"WITH {MENTIONS}, people AS (SELECT DISTINCT p FROM few) SELECT ff.i AS insight, people.p AS participant_ord, CASE WHEN s.p IS NULL THEN 'ABSENT' WHEN s.p = ff.f THEN 'NEW' ELSE 'REPEAT' END AS mark FROM ff CROSS JOIN people LEFT JOIN few s ON s.i = ff.i AND s.p = people.p")
def saturation_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations stand in for participants, segments and balance bands for insights."""
    band = F.floor(F.col("c_acctbal") / 500).cast("int").cast("string")
    o = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("participant_ord"), F.col("c_nationkey").cast("string").alias("participant"), F.concat_ws(":", "c_mktsegment", band).alias("insight"))
    return S.matrix(o).select("insight", "participant_ord", "mark")


GAPS = "few AS (SELECT DISTINCT CASE WHEN c_nationkey % 5 <> 2 THEN c_nationkey END AS p, CASE WHEN c_custkey % 10 <> 3 THEN c_mktsegment || ':' || CAST(CAST(floor(c_acctbal / 500) AS INTEGER) % 9 AS VARCHAR) END AS i FROM customer WHERE c_nationkey <> 4 OR c_custkey % 10 = 3), ff AS (SELECT i, min(p) AS f FROM few WHERE i IS NOT NULL GROUP BY i)"


@query(f"WITH {OBS}, everybody AS (SELECT count(DISTINCT p) AS a FROM obs) SELECT i AS insight, min(p) AS first_ord, CAST(1 AS BIGINT) AS new, count(*) - 1 AS repeat, (SELECT a FROM everybody) - count(*) AS absent FROM obs GROUP BY i")
def insight_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's row sums from bitmaps of users, written and read back, without its cells."""
    from loomfield.shared import new_folder

    folder = new_folder(spark, "bitmaps")
    S.bitmaps(observations(spark, sf_dir)).write.parquet(f"{folder}/maps")
    return S.marks_per_insight(spark.read.parquet(f"{folder}/maps"))


@query(f"WITH {OBS}, people AS (SELECT DISTINCT p FROM obs) SELECT firsts.i AS insight, people.p AS participant_ord, CASE WHEN s.p IS NULL THEN 'ABSENT' WHEN s.p = firsts.f THEN 'NEW' ELSE 'REPEAT' END AS mark FROM firsts CROSS JOIN people LEFT JOIN obs s ON s.i = firsts.i AND s.p = people.p")
def insight_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of the grid of users, from bitmaps; the range asked for is that of the users."""
    o = observations(spark, sf_dir)
    lo, hi = o.agg(F.min("participant_ord"), F.max("participant_ord")).first()
    return S.cells(S.bitmaps(o), 0 if lo is None else lo, -1 if hi is None else hi)


@query(f"WITH {GAPS}, people AS (SELECT DISTINCT p FROM few) SELECT ff.i AS insight, people.p AS participant_ord, CASE WHEN s.i IS NULL THEN 'ABSENT' WHEN s.p IS NOT DISTINCT FROM ff.f THEN 'NEW' ELSE 'REPEAT' END AS mark FROM ff CROSS JOIN people LEFT JOIN few s ON s.i = ff.i AND s.p IS NOT DISTINCT FROM people.p")
def saturation_matrix_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a number, insights without a name, and a nation that has no other: all of them keep their place in the grid."""
    band = F.expr("CAST(CAST(floor(c_acctbal / 500) AS INT) % 9 AS STRING)")
    who = F.when(F.col("c_nationkey") % 5 != 2, F.col("c_nationkey"))
    what = F.when(F.col("c_custkey") % 10 != 3, F.concat_ws(":", "c_mktsegment", band))
    rows = load(spark, sf_dir, "customer").where("c_nationkey <> 4 OR c_custkey % 10 = 3")
    o = rows.select(who.alias("participant_ord"), who.cast("string").alias("participant"), what.alias("insight"))
    return S.matrix(o).select("insight", "participant_ord", "mark")


@query(f"WITH {MENTIONS} SELECT ff.i AS insight, " + ", ".join(f"CASE max(CASE WHEN s.p = {k} THEN CASE WHEN s.p = ff.f THEN 2 ELSE 1 END ELSE 0 END) WHEN 2 THEN 'NEW' WHEN 1 THEN 'REPEAT' ELSE 'ABSENT' END AS n{k}" for k in range(5)) + " FROM ff JOIN few s USING (i) GROUP BY ff.i")
def saturation_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for display, with a column for each of five nations."""
    long = saturation_matrix_long(spark, sf_dir).withColumn("participant", F.concat(F.lit("n"), F.col("participant_ord").cast("string")))
    return S.matrix_wide(long, [f"n{k}" for k in range(5)])


@query(f"WITH {OBS} SELECT o.p AS participant_ord, CAST(o.p AS VARCHAR) AS participant, count(*) FILTER (WHERE o.p IS NOT DISTINCT FROM f.f) AS new_insights FROM obs o JOIN firsts f USING (i) GROUP BY o.p")
def saturation_new_per_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.new_per_participant(observations(spark, sf_dir))


@query(f"WITH {OBS}, n AS (SELECT o.p, count(*) FILTER (WHERE o.p IS NOT DISTINCT FROM f.f) AS c FROM obs o JOIN firsts f USING (i) GROUP BY o.p) SELECT p AS participant_ord, CAST(p AS VARCHAR) AS participant, c AS new_insights, CAST(sum(c) OVER (ORDER BY p) AS BIGINT) AS total_insights FROM n")
def saturation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.curve(observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT i AS insight, count(*) AS n, round(count(*) / (SELECT count(DISTINCT p) FROM obs), 6) AS share FROM obs GROUP BY i")
def insight_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frequency(observations(spark, sf_dir))


@query(f"WITH {OBS} SELECT (SELECT count(*) FROM firsts) AS insights, (SELECT count(DISTINCT p) FROM obs) AS participants, (SELECT max(f) FROM firsts) AS last_new_ord")
def saturation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(observations(spark, sf_dir))


KEYED = "SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || json_extract_string(props, '$.k') AS i FROM events WHERE event_type"


@query(f"WITH a AS ({KEYED} = 'purchase'), b AS ({KEYED} = 'error') SELECT coalesce(a.i, b.i) AS insight, a.i IS NOT NULL AS in_summary, b.i IS NOT NULL AS in_matrix FROM a FULL JOIN b ON a.i = b.i WHERE a.i IS NULL OR b.i IS NULL")
def summary_vs_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' keys of purchases stand in for the summary, those of errors for the matrix."""
    e = load(spark, sf_dir, "events").withColumn("insight", F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")))
    return S.summary_mismatch(e.where("event_type = 'purchase'"), e.where("event_type = 'error'"))


# --- journey --------------------------------------------------------------------------------

VARIANTS = "v(variant, phase_ord, phase) AS (VALUES " + ", ".join(f"('{x}', {i}, '{p}')" for i, p in enumerate(PRIORITIES, 1) for x in (f"{i}. {p}", p)) + ")"
THEMED = "themed AS (SELECT o_orderkey AS line_no, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || replace(o_orderpriority, '-', '. ') || ' ' WHEN o_orderkey % 10 = 1 THEN 'Other' ELSE upper(regexp_replace(o_orderpriority, '^[0-9]-', '')) END AS theme FROM orders)"


def themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    theme = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.replace(p, F.lit("-"), F.lit(". ")), F.lit(" "))).when(F.col("o_orderkey") % 10 == 1, "Other").otherwise(F.upper(F.regexp_replace(p, "^[0-9]-", "")))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), theme.alias("theme"))


@query(f"WITH {VARIANTS}, {THEMED} SELECT line_no, theme, CAST(phase_ord AS INTEGER) AS phase_ord, phase FROM themed JOIN v ON lower(trim(theme)) = variant")
def theme_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.route(themed(spark, sf_dir), model.variants(spark, PRIORITIES))


@query(f"WITH {VARIANTS}, {THEMED} SELECT line_no, theme, 'UNKNOWN_THEME' AS reason FROM themed WHERE lower(trim(theme)) NOT IN (SELECT variant FROM v WHERE phase_ord < 3)")
def theme_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rejects(themed(spark, sf_dir), model.variants(spark, PRIORITIES).where("phase_ord < 3"))


@query(f"WITH {VARIANTS}, {THEMED}, r AS (SELECT phase FROM themed JOIN v ON lower(trim(theme)) = variant WHERE phase <> 'high') SELECT CAST(v.phase_ord AS INTEGER) AS phase_ord, v.phase, (SELECT count(*) FROM r WHERE r.phase = v.phase) AS n FROM v WHERE variant = phase")
def phase_counts_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = model.variants(spark, PRIORITIES)
    return J.counts(J.route(themed(spark, sf_dir), v).where("phase <> 'high'"), v.where("variant = phase").select("phase_ord", "phase"))


@query("SELECT r_name, segment, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s LEFT JOIN (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9900 GROUP BY ALL) g ON g.n_regionkey = r_regionkey AND g.c_mktsegment = segment")
def journey_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and segments stand in for phases and dimensions."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    filled = c.where("c_acctbal > 9900").join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("r_regionkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    segments = c.select(F.col("c_mktsegment").alias("segment")).distinct()
    return J.complete_grid(load(spark, sf_dir, "region"), segments, filled, ["r_regionkey", "segment"], "n", F.lit(0).cast("bigint")).select("r_name", "segment", "n")


@query("SELECT p_partkey, participant, answer, CAST(participant_ord AS INTEGER) AS participant_ord FROM (SELECT p_partkey, 'p_name' AS participant, p_name AS answer, 1 AS participant_ord FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand, 2 FROM part UNION ALL SELECT p_partkey, 'p_type', p_type, 3 FROM part)")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.wide_to_long(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_partkey"])


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("F", "O", "P")))


@query("SELECT r_name, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return J.render(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey), ["r_name"], "n_nationkey", ["n_nationkey", "n_name"])


# --- cleaning -------------------------------------------------------------------------------

TRIM = r"regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"
HEADER = TRIM.format(r"regexp_replace(replace({0}, chr(160), ' '), '[ \t\r\n]+', ' ', 'g')")
IDENT = r"(regexp_matches({0}, '^0[0-9]+$') OR regexp_matches({0}, '^[0-9]{{10,}}$') OR (regexp_matches({0}, '[A-Za-z]') AND regexp_matches({0}, '[0-9]') AND NOT regexp_matches({0}, '\s')) OR regexp_matches({0}, '^\d{{4}}-\d{{2}}-\d{{2}}') OR regexp_matches({0}, '^\d{{1,2}}/\d{{1,2}}/\d{{2,4}}$'))"
MISSING = "({0} IS NULL OR " + TRIM.format("replace({0}, chr(160), ' ')") + " = '')"
CLEAN = "CASE WHEN starts_with({0}, '=') THEN {0} WHEN " + IDENT + " THEN replace({0}, chr(160), ' ') ELSE regexp_replace(" + TRIM.format("replace(replace(replace({0}, chr(160), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))") + ", ' {{2,}}', ' ', 'g') END"
TEXTS = ["segment", "ident", "mixed", "name"]
KIND = "CASE WHEN " + MISSING + " THEN 'BLANK' WHEN starts_with({0}, '=') THEN 'FORMULA' WHEN regexp_matches({0}, '^0[0-9]+$') OR regexp_matches({0}, '^[0-9]{{10,}}$') THEN 'IDENTIFIER' WHEN regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches({0}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}$') THEN 'DATE' WHEN regexp_matches({0}, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN 'NUMBER' ELSE 'TEXT' END"
TIDY = "tidy AS (SELECT row_idx, c_custkey, " + ", ".join(f"{CLEAN.format(c)} AS {c}" for c in TEXTS) + " FROM dirty)"


@query(f"WITH {DIRTY_SQL}, h AS (SELECT 's' || CAST(c_custkey % 50 AS VARCHAR) AS sheet, row_idx AS col_idx, segment AS text FROM dirty), n AS (SELECT *, {HEADER.format('text')} AS norm FROM h), d AS (SELECT *, count(*) OVER (PARTITION BY sheet, norm) AS same FROM n), s AS (SELECT *, CASE WHEN coalesce(norm, '') = '' THEN 'EMPTY' WHEN same > 1 THEN 'DUPLICATE' WHEN norm = text THEN 'SAME' ELSE 'RENAMED' END AS status FROM d) SELECT sheet, col_idx, text, status, CASE WHEN status = 'RENAMED' THEN norm ELSE text END AS clean FROM s")
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    return C.clean_headers(d.select(F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string")).alias("sheet"), F.col("row_idx").alias("col_idx"), F.col("segment").alias("text")))


@query(f"WITH {DIRTY_SQL}, {TIDY} SELECT * FROM tidy")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_table(dirty(spark, sf_dir), TEXTS)


@query(f"WITH {DIRTY_SQL} SELECT row_idx, regexp_matches(ident, '^0[0-9]+$') AS leading_zero, regexp_matches(CAST(c_custkey * 1000000007 AS VARCHAR), '^[0-9]{{10,}}$') AS long_digits, regexp_matches(name, '[A-Za-z]') AND regexp_matches(name, '[0-9]') AND NOT regexp_matches(name, '\\s') AS letters_and_digits, coalesce(regexp_matches(mixed, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches(mixed, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}$'), false) AS date_like FROM dirty")
def identifier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    return d.select("row_idx", T.leading_zero(F.col("ident")).alias("leading_zero"), T.long_digits((F.col("c_custkey") * 1000000007).cast("string")).alias("long_digits"), T.letters_and_digits(F.col("name")).alias("letters_and_digits"), F.coalesce(T.date_like(F.col("mixed")), F.lit(False)).alias("date_like"))


@query(f"WITH {DIRTY_SQL}, {TIDY}, w AS (SELECT *, row_number() OVER (PARTITION BY segment, ident, mixed, name ORDER BY row_idx) AS k FROM tidy) SELECT row_idx, c_custkey, segment, ident, mixed, name FROM w WHERE k = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean(dirty(spark, sf_dir), TEXTS)


@query(f"WITH {DIRTY_SQL}, {TIDY}, w AS (SELECT *, row_number() OVER p AS k, first_value(row_idx) OVER p AS retained FROM tidy WINDOW p AS (PARTITION BY segment, ident, mixed, name ORDER BY row_idx)) SELECT row_idx, retained FROM w WHERE k > 1")
def dedup_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.removed(C.clean_table(dirty(spark, sf_dir), TEXTS), TEXTS)


@query("SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS surplus FROM documents")
def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.duplicate_counts(load(spark, sf_dir, "documents"), ["text"])


def _each(sql: str, columns: list[str]) -> str:
    return " UNION ALL ".join(sql.format(c) for c in columns)


@query("WITH j AS (SELECT d.doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) " + _each("SELECT '{0}' AS \"column\", count(*) AS n, count(*) FILTER (WHERE {0} IS NULL) AS missing, round(100.0 * count(*) FILTER (WHERE {0} IS NULL) / count(*), 4) AS missing_pct FROM j", ["quality", "toxic", "lang"]))
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing(load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "toxic", "lang"])


@query(f"WITH {DIRTY_SQL}, k AS (" + _each("SELECT '{0}' AS \"column\", " + KIND + " AS kind FROM dirty", TEXTS) + ') SELECT "column", kind, count(*) AS n FROM k GROUP BY ALL')
def kind_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.kinds(dirty(spark, sf_dir), TEXTS)


@query(f"WITH {DIRTY_SQL}, k AS (" + _each("SELECT '{0}' AS \"column\", " + KIND + " AS kind FROM dirty", TEXTS) + ") SELECT \"column\", count(DISTINCT kind) AS n_kinds, count(DISTINCT kind) > 1 AS mixed FROM k WHERE kind <> 'BLANK' GROUP BY 1")
def mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mixed(dirty(spark, sf_dir), TEXTS)


@query("WITH q AS (SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) SELECT l_returnflag, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(lo, 6) AS lower, round(hi, 6) AS upper, (SELECT count(*) FROM lineitem l WHERE l.l_returnflag = f.l_returnflag AND (l_extendedprice < lo OR l_extendedprice > hi)) AS flagged, 'flagged_not_modified' AS state FROM f")
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)  # noqa: E731  prices have two decimals, so fences have five; fewer would cut at a tie
    return P.outliers(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", "n", *map(r, ("q1", "median", "q3", "lower", "upper")), "flagged", "state")


@query("SELECT l_orderkey, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.9), 6) AS q9 FROM lineitem GROUP BY 1")
def quantiles_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of as many groups as there are orders."""
    q = P.quantiles(load(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", (0.25, 0.9))
    return q.select("l_orderkey", "n", F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("q9"))


NULL_GROUP = "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END"


@query(f"WITH l AS (SELECT {NULL_GROUP} AS g, CASE WHEN l_linenumber = 7 THEN l_extendedprice * 100 ELSE l_extendedprice END AS v FROM lineitem), q AS (SELECT g, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM l GROUP BY g) SELECT q.g, q.n, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS flagged FROM q JOIN l ON l.g IS NOT DISTINCT FROM q.g GROUP BY q.g, q.n")
def outliers_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a group are a group."""
    v = F.when(F.col("l_linenumber") == 7, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice"))
    return P.outliers(load(spark, sf_dir, "lineitem").select(F.expr(NULL_GROUP).alias("g"), v.alias("v")), ["g"], "v").select("g", "n", "flagged")


@query("SELECT count(o_totalprice) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev, round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders")
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.describe(load(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g1, CAST(grouping(o_orderpriority) AS INTEGER) AS g2 FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


RULE_VALUES = "rules(rule_ord, rule) AS (VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(model.RULES, 1)) + ")"


@query(f"WITH {DIRTY_SQL}, {TIDY}, {RULE_VALUES}, c AS (SELECT 'DATA_WHITESPACE_NORMALIZATION' AS rule, 'customer' AS sheet, count(*) AS n FROM dirty JOIN tidy USING (row_idx) WHERE dirty.segment IS DISTINCT FROM tidy.segment UNION ALL SELECT 'IDENTIFIER_PRESERVATION', 'customer', count(*) FROM dirty WHERE regexp_matches(ident, '^0[0-9]+$')) SELECT CAST(rule_ord AS INTEGER) AS rule_ord, r.rule, sheet, coalesce(n, 0) AS n FROM rules r LEFT JOIN c ON c.rule = r.rule")
def actions_zero_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    changed = P.before_after(d, C.clean_table(d, TEXTS), ["segment"]).select(F.lit("DATA_WHITESPACE_NORMALIZATION").alias("rule"), F.lit("customer").alias("sheet"), F.col("changed").alias("n"))
    kept = d.where(T.leading_zero(F.col("ident"))).agg(F.count("*").alias("n")).select(F.lit("IDENTIFIER_PRESERVATION").alias("rule"), F.lit("customer").alias("sheet"), "n")
    return REP.actions_with_zeros(model.rules(spark), changed.unionByName(kept))


@query(f"WITH {DIRTY_SQL}, w AS (SELECT 'MISSING_VALUES_NOT_IMPUTED' AS code, 'customer' AS sheet FROM dirty WHERE segment IS NULL UNION ALL SELECT 'IDENTIFIER_PRESERVED', 'customer' FROM dirty WHERE regexp_matches(ident, '^0[0-9]+$') UNION ALL SELECT 'FORMULAS_PRESERVED', 'customer' FROM dirty WHERE starts_with(name, '=')) SELECT code, sheet, count(*) AS n FROM w GROUP BY ALL")
def warnings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    checks = (("MISSING_VALUES_NOT_IMPUTED", T.is_missing(F.col("segment"))), ("IDENTIFIER_PRESERVED", T.leading_zero(F.col("ident"))), ("FORMULAS_PRESERVED", T.is_formula(F.col("name"))))
    return REP.warning_counts(R.union_all([d.where(c).select(F.lit(code).alias("code"), F.lit("customer").alias("sheet")) for code, c in checks]))


@query(f"WITH {DIRTY_SQL}, {TIDY} " + _each("SELECT '{0}' AS \"column\", count(*) FILTER (WHERE d.{0} IS DISTINCT FROM t.{0}) AS changed, count(*) FILTER (WHERE " + MISSING.format("d.{0}") + ") AS missing_before, count(*) FILTER (WHERE " + MISSING.format("t.{0}") + ") AS missing_after FROM dirty d JOIN tidy t USING (row_idx)", TEXTS))
def before_after_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dirty(spark, sf_dir)
    return P.before_after(d, C.clean_table(d, TEXTS), TEXTS)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)")
def except_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without a rich customer stand in for expected artifacts that are missing."""
    return R.missing_artifacts(load(spark, sf_dir, "nation").select("n_nationkey"), load(spark, sf_dir, "customer").where("c_acctbal > 9950").select(F.col("c_nationkey").alias("n_nationkey")).distinct())


@query(f"WITH {DIRTY_SQL}, {TIDY}, k AS (SELECT c_custkey, row_number() OVER (PARTITION BY segment, ident, mixed, name ORDER BY row_idx) AS n FROM tidy) SELECT CAST(c_custkey % 100 AS INTEGER) AS part, count(*) AS cleaned, count(*) AS cleaned_twice, CAST(0 AS BIGINT) AS differ FROM k WHERE n = 1 GROUP BY 1")
def idempotence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows after cleaning once and twice, and rows that only either has."""
    once = C.clean(dirty(spark, sf_dir), TEXTS)
    twice = C.clean(once, TEXTS)
    part = (F.col("c_custkey") % 100).cast("int").alias("part")
    n = lambda rows, name: rows.groupBy(part).agg(F.count("*").alias(name))
    return n(once, "cleaned").join(n(twice, "cleaned_twice"), "part", "full").join(n(R.set_difference(once, twice), "differ"), "part", "left").withColumn("differ", F.coalesce("differ", F.lit(0)).cast("bigint"))


@query("SELECT sha256(text) AS sha256, doc_id FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("sha256"))


# --- questionnaires and answers --------------------------------------------------------------


@query("WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1009 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM a WHERE o_orderkey % 997 <> 5 UNION ALL SELECT * FROM a WHERE o_orderkey % 1013 = 7) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which some are changed, missing or there twice."""
    a = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    b = a.where(k % 997 != 5).withColumn("o_totalprice", F.when(k % 1009 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).unionByName(a.where(k % 1013 == 7))
    return R.set_difference(a, b)


@query("SELECT conv_id, turn, question, CASE WHEN nr = 'assistant' THEN nt END AS reply FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.reply_pairs(load(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return Q.fill_forward(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "heading").select("conv_id", "turn", "heading")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.evidence(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")), "text", "quote", "doc_id", "item_id")


@query("WITH q AS (SELECT item_id, array_to_string(string_split(text, ' ')[3:4 + item_id % 6], ' ') AS quote FROM benchmark) SELECT d.doc_id, q.item_id FROM documents d JOIN q ON contains(d.text, q.quote)")
def evidence_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of two to seven words, from the third word of each item on."""
    quote = F.array_join(F.slice(F.split("text", " "), F.lit(3), F.lit(2) + (F.col("item_id") % 6).cast("int")), " ")
    return Q.evidence(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark").select("item_id", quote.alias("quote")), "text", "quote", "doc_id", "item_id")


@query("SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS target_no, unnest(string_split(text, chr(10))) AS target FROM documents")
def multi_value_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.targets(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query("SELECT lang, sum(len(string_split(text, chr(10))))::BIGINT AS n_targets, count(*) AS n FROM documents GROUP BY lang")
def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.target_counts(load(spark, sf_dir, "documents"), "text").groupBy("lang").agg(F.sum("n_targets").alias("n_targets"), F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.outside_domain(load(spark, sf_dir, "events").select("event_id", "event_type"), spark.createDataFrame([("view",), ("click",)], "event_type string"), "event_type")


@query("WITH s AS (SELECT event_type AS category, CAST(json_extract_string(props, '$.k') AS INTEGER) AS num, 100 AS den FROM events) SELECT category, CAST(sum(num) AS BIGINT) AS points, CAST(sum(den) AS BIGINT) AS possible, count(*) AS criteria, round(sum(num) / sum(den), 6) AS mean, CAST(grouping(category) AS INTEGER) AS is_total FROM s GROUP BY ROLLUP (category)")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.concat(F.get_json_object("props", "$.k"), F.lit("/100"))
    return K.rollup(load(spark, sf_dir, "events").select(F.col("event_type").alias("category"), T.score_num(score).alias("num"), T.score_den(score).alias("den")))


@query("SELECT event_type, CAST(sum(event_id % 86400) AS BIGINT) AS seconds, min(strftime(make_timestamp((event_id % 86400) * 1000000), '%H:%M:%S')) AS first_clock FROM events GROUP BY 1")
def clock_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = T.clock_of(F.col("event_id") % 86400)
    return load(spark, sf_dir, "events").withColumn("clock", clock).groupBy("event_type").agg(F.sum(T.seconds_of(F.col("clock"))).alias("seconds"), F.min("clock").alias("first_clock"))


# --- extensions: joins, windows, sets, streams ------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_linenumber BETWEEN 1 AND 3")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").where("l_quantity BETWEEN 10 AND 20 AND l_linenumber BETWEEN 1 AND 3").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.streaming.events import tumbling

    return tumbling(load(spark, sf_dir, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 4)})


@query("WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions(load(spark, sf_dir, "events"), "user_id", "ts", 1800)


@query("WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS e FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, p.user_id, p.ts, v.e AS last_view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest earlier view."""
    e = load(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return R.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["view_id"]).select("event_id", "user_id", "ts", "last_view_id")


@query("SELECT c_mktsegment, r_name, count(*) AS n, CAST(grouping(c_mktsegment) AS INTEGER) AS g1, CAST(grouping(r_name) AS INTEGER) AS g2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (c_mktsegment, r_name)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.cube("c_mktsegment", "r_name").agg(F.count("*").alias("n"), F.grouping("c_mktsegment").cast("int").alias("g1"), F.grouping("r_name").cast("int").alias("g2"))


@query("SELECT 'with' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    side = lambda how, name: c.join(o, c.c_custkey == o.o_custkey, how).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return side("left_semi", "with").unionByName(side("left_anti", "without"))


@query("SELECT r_name, year(o_orderdate)::INTEGER AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, c, n, r = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02 00:00:00'"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3)


@query("SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER w AS change, CAST(rank() OVER w AS INTEGER) AS rank, round(percent_rank() OVER w, 6) AS percent_rank, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.lag("o_totalprice").over(w)).alias("change"), F.rank().over(w).alias("rank"), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.ntile(4).over(w).alias("quarter"))


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_nationkey").intersect(load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@query("WITH r AS (SELECT p_partkey, p_retailprice AS lo, p_retailprice + 3 AS hi FROM part) SELECT s_suppkey, p_partkey FROM supplier JOIN r ON s_acctbal BETWEEN lo AND hi")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier balances within the price band of a part."""
    bands = load(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 3).alias("hi"))
    return R.range_join(load(spark, sf_dir, "supplier"), bands, "s_acctbal", "lo", "hi", 3.0).select("s_suppkey", "p_partkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INTEGER) AS g1, CAST(grouping(o_orderpriority) AS INTEGER) AS g2 FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    sets = o.groupingSets([[o.o_orderstatus], [o.o_orderpriority], []], o.o_orderstatus, o.o_orderpriority)
    return sets.agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("g1"), F.grouping("o_orderpriority").cast("int").alias("g2"))


@query("SELECT o_orderkey, count(*) OVER w AS orders_30d, round(sum(o_totalprice) OVER w, 2) AS spent_30d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) - DATE '1970-01-01' RANGE BETWEEN 30 PRECEDING AND CURRENT ROW)")
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders of the last thirty days, by a frame over days rather than rows."""
    w = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.col("o_orderdate").cast("date"))).rangeBetween(-30, Window.currentRow)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(w).alias("orders_30d"), F.round(F.sum("o_totalprice").over(w), 2).alias("spent_30d"))


@query("SELECT coalesce(c.k, s.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1) s ON c.k = s.k")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in debt by nation, whichever side has any; both sides are aggregated before they meet."""
    side = lambda t, k, b, n: load(spark, sf_dir, t).where(F.col(b) < 0).groupBy(F.col(k).alias("nation")).agg(F.count("*").alias(n))
    both = side("customer", "c_nationkey", "c_acctbal", "customers").join(side("supplier", "s_nationkey", "s_acctbal", "suppliers"), "nation", "full_outer")
    return both.select("nation", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "suppliers")))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersectAll(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT DISTINCT json_extract_string(props, '$.k') || ':' || CAST(user_id AS VARCHAR) AS insight FROM events WHERE event_type IN ('click', 'view')")
def merge_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views stand in for two participants' lists, merged without repetitions."""
    e = load(spark, sf_dir, "events").withColumn("insight", F.concat_ws(":", F.get_json_object("props", "$.k"), F.col("user_id").cast("string")))
    return R.union_all([e.where(F.col("event_type") == x).select("insight") for x in ("click", "view")]).distinct()


@query("SELECT lang, source, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 4) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.withColumn("share", T.percent(F.col("n"), F.sum("n").over(Window.partitionBy("lang"))))


@query(f"WITH {VARIANTS}, {THEMED}, r AS (SELECT line_no, theme, phase_ord, phase FROM themed JOIN v ON lower(trim(theme)) = variant) SELECT line_no, theme, CAST(phase_ord AS INTEGER) AS phase_ord, phase, CAST(phase_ord AS VARCHAR) || '-' || regexp_replace(phase, '\\s+', '-', 'g') AS slug, line_no = min(line_no) OVER (PARTITION BY phase_ord) AS opens FROM r")
def phase_files_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases' files one after another, each in source order; `opens` marks a file's first row."""
    routed = J.route(themed(spark, sf_dir), model.variants(spark, PRIORITIES))
    first = routed.groupBy("phase").agg(F.min("line_no").alias("first_line"))
    rows = routed.join(first, "phase").withColumn("opens", F.col("line_no") == F.col("first_line"))
    return rows.select("line_no", "theme", "phase_ord", "phase", F.concat_ws("-", F.col("phase_ord").cast("string"), T.slug(F.col("phase"))).alias("slug"), "opens").orderBy("phase_ord", "line_no")


# --- documents, cells and scalar functions -----------------------------------------------------


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small pipe table for each part: one good row with an escaped pipe, then a short row or a row of dashes."""
    p = load(spark, sf_dir, "part")
    last = F.when(F.col("p_partkey") % 3 == 0, "| short | row |").otherwise("| - | - | - |")
    row = T.pipe_line(F.col("p_size"), F.col("p_name"), F.replace("p_brand", F.lit("#"), F.lit("|")))
    docs = p.select(F.col("p_partkey").cast("string").alias("doc"), F.concat_ws("\n", F.lit("| Size | Name | Brand |"), F.lit("|---|:-:|---|"), row, last).alias("value"))
    return M.tables(M.split_lines(docs))


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, 3 AS line_no, CAST(p_size AS VARCHAR) AS size, p_name AS name, replace(p_brand, '#', '|') AS brand FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 4, '-', '-', '-' FROM part WHERE p_partkey % 3 <> 0")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.as_table(part_tables(spark, sf_dir), ["size", "name", "brand"]).drop("section")


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc, 4 AS line_no, '| short | row |' AS raw, 'MALFORMED_ROW' AS reason FROM part WHERE p_partkey % 3 = 0")
def markdown_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.malformed(part_tables(spark, sf_dir))


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one document a customer: two participants' insights and a summary."""
    c = load(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    head = ("| # | Insight | Quotes |", "|---|---|---|")
    value = F.concat_ws(
        "\n",
        F.concat(F.lit("# Insights — "), F.col("c_name")), *map(F.lit, head), F.concat(F.lit("| 1 | "), F.col("c_mktsegment"), F.lit(' | "yes" |')), F.concat(F.lit("| 2 | nation "), nation, F.lit(' | "no" |')),
        F.lit(""), F.lit("# Insights — Zoe"), *map(F.lit, head), F.concat(F.lit("| 1 | nation "), nation, F.lit(' | "well" |')),
        F.lit(""), F.lit("## Summary"), F.concat(F.lit("- **"), F.col("c_mktsegment"), F.lit("**: of nation "), nation),
    )
    return M.split_lines(c.select(F.col("c_custkey").cast("string").alias("doc"), value.alias("value")))


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS doc, * FROM customer) SELECT doc, 1 AS participant_ord, c_name AS participant, 1 AS insight_no, c_mktsegment AS insight, '"yes"' AS quote FROM c UNION ALL SELECT doc, 1, c_name, 2, 'nation ' || c_nationkey, '"no"' FROM c UNION ALL SELECT doc, 2, 'Zoe', 1, 'nation ' || c_nationkey, '"well"' FROM c""")
def insight_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.insight_observations(interviews(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc, c_mktsegment AS insight, 'of nation ' || c_nationkey AS summary FROM customer")
def summary_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary_bullets(interviews(spark, sf_dir))


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each customer: some begin with a blank row, have equal names in the first row, or a number as a name."""
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    second = F.when(key % 4 == 1, F.col("c_mktsegment")).when(key % 4 == 2, "12").otherwise("Name")
    cell = lambda row, col, kind, text: F.struct((row + F.when(key % 5 == 0, 1).otherwise(0)).alias("row_idx"), F.lit(col).alias("col_idx"), kind.alias("kind"), text.alias("text"))
    text, number = F.lit("TEXT"), F.lit("NUMBER")
    cells = F.array(cell(F.lit(1), 1, text, F.col("c_mktsegment")), cell(F.lit(1), 2, F.when(key % 4 == 2, number).otherwise(text), second), cell(F.lit(2), 1, number, F.col("c_nationkey").cast("string")), cell(F.lit(2), 2, text, F.col("c_name")))
    return c.select(key.cast("string").alias("sheet"), F.explode(cells).alias("c")).select("sheet", "c.*")


@query("SELECT CAST(c_custkey AS VARCHAR) AS sheet, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS header_row, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'UNCERTAIN_HEADER' ELSE 'CONFIRMED' END AS header_status FROM customer")
def header_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.header_status(customer_cells(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sheet, CAST(h + 1 AS INTEGER) AS row_idx, 1 AS col_idx, CAST(c_nationkey AS VARCHAR) AS text FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS h FROM customer) WHERE c_custkey % 4 NOT IN (1, 2) UNION ALL SELECT CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 2 END, 2, c_name FROM customer WHERE c_custkey % 4 NOT IN (1, 2)")
def data_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = customer_cells(spark, sf_dir)
    return C.data_region(cells, C.header_status(cells)).select("sheet", "row_idx", "col_idx", "text")


@query("SELECT p_type AS category, p_name AS criterion, count(*) AS n, CAST(sum(n_solutions) AS BIGINT) AS n_solutions FROM (SELECT p_type, p_name, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS n_solutions FROM part WHERE p_size % 3 <> 0) GROUP BY ALL")
def nested_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scorecards, one a part; a third of them only say that nothing is needed."""
    size = F.col("p_size")
    solutions = F.when(size % 3 == 0, F.array(F.lit(K.NO_SOLUTION))).when(size % 2 == 0, F.array(F.lit("more"), F.lit(K.NO_SOLUTION))).otherwise(F.array(F.lit("more"), F.lit("less")))
    score = F.struct(F.concat(size.cast("string"), F.lit("/50")).alias("score"), F.lit("as is").alias("analysis"), solutions.alias("solutions"))
    cards = load(spark, sf_dir, "part").select(F.create_map("p_type", F.create_map("p_name", score)).cast(K.NESTED).alias("groups"))
    return K.with_solutions(K.explode_scores(cards)).groupBy("category", "criterion").agg(F.count("*").alias("n"), F.sum("n_solutions").cast("bigint").alias("n_solutions"))


@query(
    "SELECT p_partkey, replace(p_name, ' ', '-') AS slug, p_name AS stem, '.md' AS extension, p_name AS fenced, p_name AS plain, p_size AS rating, p_size % 2 = 0 AS approved, p_size % 3 = 0 AS optional, "
    "p_size AS r1, p_size % 26 + 1 AS c1, p_size + 7 AS r2, 26 + p_size % 26 + 1 AS c2, 'insight ' || p_size AS label, CASE p_size % 4 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REPEAT' WHEN 2 THEN 'ABSENT' END AS mark, p_name || '\n' || p_name || '\n' AS lines, regexp_extract(p_brand, '[0-9]+')::INTEGER AS num FROM part"
)
def artifact_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on names, paths, fenced replies, approvals, addresses, marks and labels."""
    name, size, text = F.col("p_name"), F.col("p_size"), F.col("p_size").cast("string")
    letter = F.char(size % 26 + 65)
    address = T.range_corners(F.concat(letter, text, F.lit(":A"), letter, (size + 7).cast("string")))
    symbol = F.element_at(F.array(*(F.lit(x) for x in (*model.MARKS.values(), "?"))), size % 4 + 1)
    path = F.concat(F.lit("Study.v2/Interview/"), name, F.lit(".MD"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", T.slug(F.initcap(name)).alias("slug"), T.path_stem(path).alias("stem"), T.path_extension(path).alias("extension"),
        T.fenced_block(F.concat(F.lit("Here:\n```markdown\n"), name, F.lit("\n```\nDone"))).alias("fenced"), T.fenced_block(F.concat(F.lit("  "), name, F.lit(" "))).alias("plain"),
        T.rating_of(F.concat(F.lit("I'd say "), text, F.lit(" of 50"))).alias("rating"), T.is_approval(F.when(size % 2 == 0, " Approved ").otherwise("later")).alias("approved"),
        T.is_optional(F.when(size % 3 == 0, F.concat(name, F.lit(" (optional)"))).otherwise(name)).alias("optional"), *(address[c].alias(c) for c in ("r1", "c1", "r2", "c2")),
        T.bare_label(F.concat(F.lit("🔵 **insight "), text, F.lit("**"))).alias("label"), T.mark_of(symbol).alias("mark"), T.line_endings(F.concat(name, F.lit("\r\n"), name, F.lit("\r"))).alias("lines"), T.score_num(F.concat(F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("/25"))).alias("num"),
    )


# --- what only workflows use, on tables --------------------------------------------------------


def marked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' cells; some sheets have a formula, some a merged first column."""
    key = F.col("sheet").cast("bigint")
    rows = customer_cells(spark, sf_dir)
    formula = (key % 6 == 0) & (F.col("col_idx") == 2) & (F.col("text") == F.concat(F.lit("Customer#"), F.lpad("sheet", 9, "0")))
    return rows.withColumns({"kind": F.when(formula, "FORMULA").otherwise(F.col("kind")), "in_merge": (key % 7 == 0) & (F.col("col_idx") == 1)})


@query("SELECT CAST(c_custkey AS VARCHAR) AS sheet, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 2 END AS n_rows, 2 AS n_cols, CAST(4 AS BIGINT) AS populated, CAST(CASE WHEN c_custkey % 6 = 0 AND c_name = 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') THEN 1 ELSE 0 END AS BIGINT) AS formulas, CAST(CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS merged_cells FROM customer")
def sheet_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sheet_counts(marked_cells(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sheet, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 2 END AS row_idx, CAST(c_nationkey AS VARCHAR) AS text FROM customer WHERE c_custkey % 4 NOT IN (1, 2) AND c_custkey % 7 <> 0")
def structural_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First columns of the data of sheets that no merged range puts under review."""
    cells = marked_cells(spark, sf_dir)
    return C.data_region(cells, C.header_status(cells), cells.where("in_merge")).where("col_idx = 1").select("sheet", "row_idx", "text")


@query("SELECT CAST(c_custkey AS VARCHAR) AS sheet, 2 AS row_idx, 2 AS col_idx, CASE WHEN c_custkey % 5 <> 0 THEN c_name WHEN c_custkey % 4 = 1 THEN c_mktsegment WHEN c_custkey % 4 = 2 THEN '12' ELSE 'Name' END AS text FROM customer")
def sub_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.sources.xlsx import used_range

    return used_range(customer_cells(spark, sf_dir), "B2:D2").select("sheet", "row_idx", "col_idx", "text")


@query("SELECT CAST(c_custkey AS VARCHAR) AS workbook, CAST(k + 1 + c_custkey % 3 AS INTEGER) AS row_idx, CAST(k AS VARCHAR) AS question_no, c_mktsegment AS theme, c_name || ' ' || k AS question FROM customer CROSS JOIN range(1, 3) t(k) WHERE c_custkey % 5 <> 0")
def questionnaire_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook a customer, its questions below up to two rows of titles, its columns in one of two orders; a fifth has them on another sheet."""
    c, key = load(spark, sf_dir, "customer"), F.col("c_custkey")
    cell = lambda row, col, text: F.struct((row + key % 3).cast("int").alias("row_idx"), F.when(key % 2 == 0, 4 - col).otherwise(col).cast("int").alias("col_idx"), text.alias("text"))
    head = [cell(F.lit(1), i, F.lit(x)) for i, x in enumerate(("STT", "Theme", "Câu hỏi"), 1)]
    body = [x for k in (1, 2) for x in (cell(F.lit(1 + k), 1, F.lit(str(k))), cell(F.lit(1 + k), 2, F.col("c_mktsegment")), cell(F.lit(1 + k), 3, F.concat("c_name", F.lit(f" {k}"))))]
    title = F.struct(F.lit(0).alias("row_idx"), F.lit(1).alias("col_idx"), F.lit("Question").alias("text"))
    rows = c.select(key.cast("string").alias("workbook"), F.when(key % 5 == 0, "Notes").otherwise(Q.SHEET).alias("sheet"), F.explode(F.array(title, *head, *body)).alias("c")).select("workbook", "sheet", "c.*")
    return Q.of_cells(rows.select("*", F.lit("TEXT").alias("kind"), F.lit(None).cast("string").alias("formula"))).select("workbook", "row_idx", "question_no", "theme", "question")


@query("SELECT CAST(c_custkey AS VARCHAR) AS sheet, CAST(k AS INTEGER) AS place, CAST((k - 1) // 2 + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS INTEGER) AS row_idx, CAST((k - 1) % 2 + 1 AS INTEGER) AS col_idx FROM customer CROSS JOIN range(1, 5) t(k)")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells numbered in the order of a report: sheet, row, column, then text."""
    w = Window.partitionBy("sheet").orderBy("row_idx", "col_idx", "text")
    return customer_cells(spark, sf_dir).select("sheet", F.row_number().over(w).alias("place"), "row_idx", "col_idx")


@query(f"WITH {DIRTY_SQL}, k AS (" + _each("SELECT '{0}' AS \"column\", " + KIND + " AS kind FROM dirty", TEXTS) + ") SELECT \"column\" FROM k WHERE kind = 'NUMBER' GROUP BY 1 HAVING count(*) >= 4")
def numeric_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.numeric_candidates(P.kinds(dirty(spark, sf_dir), TEXTS))


@query("SELECT CAST(NULL AS VARCHAR) AS sheet, CAST(NULL AS VARCHAR) AS \"range\", 'join_analysis=not_applicable; reason=no_explicit_key_contract; joins_performed=0' AS status")
def cross_sheet_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REP.no_joins(spark, ["sheet"])


@query("SELECT c_custkey AS question_no, c_name AS question, o_orderkey AS answer_no FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def answers_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand in for questions, their pending orders for answers; those without stay."""
    questions = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_no"), F.col("c_name").alias("question"))
    return Q.answers(questions, load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("question_no"), F.col("o_orderkey").alias("answer_no")))


@query("SELECT c_custkey, theme, CASE theme " + " ".join(f"WHEN '{t}' THEN '{colour}'" for t, colour in model.THEME_COLOURS.items()) + " END AS colour FROM (SELECT c_custkey, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(model.THEMES)) + " ELSE 'none' END AS theme FROM customer)")
def theme_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    theme = F.coalesce(F.get(F.array(*map(F.lit, model.THEMES)), (F.col("c_custkey") % 7).cast("int")), F.lit("none"))
    return load(spark, sf_dir, "customer").select("c_custkey", theme.alias("theme")).withColumn("colour", T.theme_colour(F.col("theme")))


@query(f"WITH {VARIANTS}, {THEMED} SELECT line_no, phase FROM themed JOIN v ON lower(trim(theme)) = variant")
def phases_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases' rows, taken apart and put one after another again."""
    routed = J.route(themed(spark, sf_dir), model.variants(spark, PRIORITIES)).select("line_no", "phase")
    return R.union_all([routed.where(F.col("phase") == p) for p in PRIORITIES])


# --- extensions: streams in batch, joins, aggregates, functions ---------------------------------


@query("SELECT CAST(time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events CROSS JOIN range(0, 2) t(k) GROUP BY ALL")
def sliding_half_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that begin every twelve hours."""
    from loomfield.streaming.events import tumbling

    return tumbling(load(spark, sf_dir, "events"), "1 day", "12 hours").withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 4)})


@query("WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.streaming.events import session_counts

    return session_counts(load(spark, sf_dir, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_type, min(ts) AS first_ts FROM events GROUP BY 1")
def first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomfield.streaming.events import first_seen

    return first_seen(load(spark, sf_dir, "events").select("event_type", "ts"), ["event_type"]).withColumnRenamed("ts", "first_ts")


def event_stream(spark: SparkSession, sf_dir: str, folder: str, files: int = 4) -> DataFrame:
    """The events as a stream of several files, a batch each, whose times overlap."""
    e = load(spark, sf_dir, "events")
    e.repartition(files, "event_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def stream_query(sql: str, mode: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a query that runs a stream over the events to its end."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from loomfield.shared import new_folder
            from loomfield.streaming.events import finished

            folder = new_folder(spark, f.__name__)
            # an append is of one batch: rows of later ones would be late
            return finished(f(event_stream(spark, sf_dir, folder, 1 if mode == "append" else 4)), mode, folder)

        run.__name__ = f.__name__
        return query(sql)(run)

    return add


@stream_query("SELECT start, event_type, n, value FROM (SELECT CAST(time_bucket(INTERVAL 12 HOUR, ts) - to_hours(12 * k) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events CROSS JOIN range(0, 2) t(k) GROUP BY ALL)", "complete")
def stream_sliding(events: DataFrame) -> DataFrame:
    """Days that begin every twelve hours, of a stream."""
    from loomfield.streaming.events import tumbling

    return tumbling(events, "1 day", "12 hours").withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 4)})


@stream_query("WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM s GROUP BY user_id, k", "complete")
def stream_sessions(events: DataFrame) -> DataFrame:
    """Session windows of a stream, which join as rows between them come. The batches overlap, so rows may be as late as they like."""
    from loomfield.streaming.events import session_counts

    return session_counts(events, late="10000 days").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@stream_query("SELECT p.event_id AS purchase_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 12 HOUR WHERE p.event_type = 'purchase' AND e.event_type = 'error'", "append")
def stream_interval_join(events: DataFrame) -> DataFrame:
    """A user's errors within twelve hours after a purchase, by a join of two streams."""
    from loomfield.streaming.events import joined_within

    of = lambda kind, name, at: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(at))
    return joined_within(of("purchase", "purchase_id", "bought"), of("error", "error_id", "failed"), ["user_id"], ("bought", "failed"), "12 HOURS").select("purchase_id", "error_id")


@query("SELECT user_id, event_id, ts AS first_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event by time, of a stream whose batches overlap: the last revision of each."""
    from loomfield.shared import new_folder
    from loomfield.streaming.events import finished, first_seen

    folder = new_folder(spark, "first_sightings")
    revised = finished(first_seen(event_stream(spark, sf_dir, folder).select("user_id", "event_id", "ts"), ["user_id"]), "update", folder)
    last = revised.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts"), "batch").alias("r"))
    return last.select("user_id", "r.event_id", F.col("r.ts").alias("first_ts"))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a lower region with a higher number: no equality to join by. A lookup of 25 rows."""
    a, b = load(spark, sf_dir, "nation").alias("a"), load(spark, sf_dir, "nation").alias("b")
    return a.join(b, F.expr("a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON o_custkey = c_custkey")
def right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return large.join(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "right").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p.event_id AS purchase_id, e.event_id AS error_id FROM events p JOIN events e ON p.user_id = e.user_id AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 12 HOUR WHERE p.event_type = 'purchase' AND e.event_type = 'error'")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's errors within twelve hours after a purchase, by user and half day."""
    e = load(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    width = 12 * 3600 * 1_000_000
    purchases = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("at").alias("lo"), (F.col("at") + width).alias("hi"))
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), "at")
    return R.range_join(errors, purchases, "at", "lo", "hi", float(width), ("user_id",)).select("purchase_id", "error_id")


@query("WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY ALL) SELECT user_id, day, event_type FROM v JOIN s USING (user_id) WHERE v.lo <= s.hi AND s.lo <= v.hi")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's days, from the first event to the last, with the spans, mostly of weeks, between the user's first and last event of each type."""
    e = load(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("at").alias("day_lo"), F.max("at").alias("day_hi"))
    spans = e.groupBy("user_id", "event_type").agg(F.min("at").alias("type_lo"), F.max("at").alias("type_hi"))
    both = R.overlap_join(days, spans, ("day_lo", "day_hi"), ("type_lo", "type_hi"), 12 * 3600 * 1e6, ("user_id",))
    return both.select("user_id", "day", "event_type")


@query("SELECT 'broadcast' AS strategy, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'merge', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'shuffle_hash', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join by three strategies; the lookup that is broadcast has a row for each nation."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    each = [c.join(n.hint(h), c.c_nationkey == n.n_nationkey).agg(F.count("*").alias("n")).select(F.lit(h).alias("strategy"), "n") for h in ("broadcast", "merge", "shuffle_hash")]
    return R.union_all(each)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_orders_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 50)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 32")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty-two rows and four columns to look at."""
    return R.preview(load(spark, sf_dir, "customer"), ["c_custkey"])


@query("SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS lengths, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars > 1000) AS long_ones FROM documents GROUP BY lang")
def distinct_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several distinct counts beside plain aggregates."""
    long = F.count(F.when(F.col("n_chars") > 1000, 1)).alias("long_ones")
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("n_chars").alias("lengths"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), long)


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, TRUE AS near FROM lineitem GROUP BY 1")
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sketch's distinct count is within a tenth of the exact one (its standard error is 0.02)."""
    exact = F.count_distinct("l_orderkey")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(exact.alias("orders"), F.approx_count_distinct("l_orderkey", 0.02).alias("about")).select("l_returnflag", "orders", (F.abs(F.col("about") - F.col("orders")) * 10 <= F.col("orders")).alias("near"))


@query("SELECT o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, strftime(o_orderdate, '%Y-%m') AS month, round(ln(o_totalprice), 6) AS log_price, round(sqrt(o_totalprice), 6) AS root, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, CAST(greatest(o_custkey % 7, 3) AS BIGINT) AS most FROM orders")
def calendar_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, price = F.col("o_orderdate").cast("date"), F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.last_day(day).alias("month_end"), F.add_months(day, 1).alias("next_month"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days"), F.quarter(day).alias("quarter"), (F.weekday(day) + 1).alias("weekday"), F.date_format(day, "yyyy-MM").alias("month"),
        F.round(F.log(price), 6).alias("log_price"), F.round(F.sqrt(price), 6).alias("root"), F.floor(price / 1000).alias("thousands"), F.greatest(F.col("o_custkey") % 7, F.lit(3).cast("bigint")).alias("most"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(1 AS INTEGER) AS n_keys, '{\"type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS again, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS large FROM events")
def json_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.from_json("props", "map<string,int>")
    k = found["k"]
    large = F.map_filter(found, lambda _, v: v > 50)["k"]
    return load(spark, sf_dir, "events").select("event_id", k.alias("k"), F.size(found).alias("n_keys"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("again"), large.alias("large"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS slug, CAST(3600 + 60 * (p_size % 60) + 7 AS BIGINT) AS seconds, CASE p_size % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'REPEAT' ELSE 'ABSENT' END AS mark, round(p_size / 50.0, 6) AS score, 'b' AS second_target FROM part")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's own functions in SQL text, one of them a table function."""
    from loomfield.functions import sql

    sql.register(spark)
    symbols = ", ".join(f"'{x}'" for x in model.MARKS.values())
    return spark.sql(
        f"SELECT p_partkey, slug_of(p_name) AS slug, seconds_of(concat('01:', lpad(p_size % 60, 2, '0'), ':07')) AS seconds, mark_of(element_at(array({symbols}), p_size % 3 + 1)) AS mark, round(score_of(concat(p_size, '/50')), 6) AS score, t.target AS second_target "
        "FROM {parts}, LATERAL targets_of('a\nb') t WHERE t.target_no = 1", parts=load(spark, sf_dir, "part"),
    )


@query("WITH e AS (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(CASE WHEN i > 1 AND p = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS k FROM e) SELECT user_id, event_type AS value, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, k, event_type")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type, user by user, by a table function over a partitioned table."""
    from loomfield.functions import table

    table.register(spark)
    return spark.sql("SELECT * FROM runs_of(TABLE(SELECT user_id, event_id, event_type, ts FROM {events}) PARTITION BY user_id ORDER BY (ts, event_id), 'event_type', 'ts', 'user_id')", events=load(spark, sf_dir, "events"))


@query("SELECT event_type, count(*) AS n, TRUE AS distinct_near, TRUE AS median_near FROM events GROUP BY ROLLUP (event_type)")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day and type, written, then merged to types and to all; the estimates are held against exact counts: users within 6 %, the median's rank within 2 %."""
    from loomfield.operators import sketches as K2
    from loomfield.shared import new_folder

    e, folder = load(spark, sf_dir, "events"), new_folder(spark, "sketches")
    K2.build(e.withColumn("day", F.to_date("ts")), ["day", "event_type"], "user_id", "value").write.parquet(f"{folder}/days")
    types = K2.merge(spark.read.parquet(f"{folder}/days"), ["event_type"])
    every = K2.merge(types.withColumn("event_type", F.lit(None).cast("string")), ["event_type"])
    about = K2.estimates(types.unionByName(every), (0.5,)).select("event_type", "n", "about", F.col("q")[0].alias("m"))
    both = e.select("event_type", "user_id", "value").unionByName(e.select(F.lit(None).cast("string").alias("event_type"), "user_id", "value"))
    named = about.withColumnRenamed("event_type", "t")
    ranked = both.join(named, both["event_type"].eqNullSafe(named["t"])).groupBy("event_type", "n", "about")
    exact = ranked.agg(F.count_distinct("user_id").alias("users"), (F.count(F.when(F.col("value") <= F.col("m"), 1)) / F.count("value")).alias("upto"), (F.count(F.when(F.col("value") < F.col("m"), 1)) / F.count("value")).alias("below"))
    return exact.select("event_type", "n", (F.abs(F.col("about") - F.col("users")) <= 0.06 * F.col("users")).alias("distinct_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))

"""Checks of sampling, corpus statistics and profiles on orders, events, documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..elements import elements, twins
from ..elements import TWINS
from ..operators import corpus as C
from ..operators import decode as J
from ..operators import gates as Q
from ..operators import geometry as G
from ..operators import sampling as S
from ..operators import scoring as P
from .base import _values, add_view, element_sets_view, query, table

add_view("twins", "", "SELECT * FROM (VALUES " + _values(sorted(TWINS.items())) + ") t(symbol, twin)")


def symbols(spark, sf_dir):
    """Element sets with symbols; the element table has 94 rows."""
    return element_sets_view(spark, sf_dir).join(F.broadcast(elements(spark)), "zn")


def gids(spark, sf_dir):
    return C.group_id(symbols(spark, sf_dir), ["set_id"])


@query("group_split", "set_gid", """
    SELECT set_id, n_elements, gid, CASE WHEN gid % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM set_gid""")
def group_split(spark, sf_dir):
    return C.assign_split(gids(spark, sf_dir))


@query("exclude_val", "set_gid", "SELECT n_elements, count(*) AS n FROM set_gid WHERE gid % 10 <> 0 GROUP BY n_elements")
def exclude_val(spark, sf_dir):
    return C.exclude_val(gids(spark, sf_dir)).groupBy("n_elements").agg(F.count(F.lit(1)).alias("n"))


@query("map_elements", "elements", """
    SELECT p_partkey, coalesce(zn, 0) AS zn
    FROM part LEFT JOIN elements ON symbol = CASE WHEN p_size <= 25 THEN (
        SELECT e.symbol FROM elements e WHERE e.zn = CAST(substr(p_brand, 7) AS INT)) ELSE 'X' || p_size END""")
def map_elements(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("zn", F.substring("p_brand", 7, 9).cast("int"))
    named = parts.join(F.broadcast(elements(spark)), "zn").withColumn(
        "symbol", F.when(F.col("p_size") <= 25, F.col("symbol")).otherwise(F.concat(F.lit("X"), F.col("p_size"))))
    return G.map_elements(named.select("p_partkey", "symbol"), elements(spark)).select("p_partkey", "zn")


@query("reject_disordered", "", """
    SELECT l_orderkey AS structure_id, count(*) AS n_sites, round(min(1 - l_discount), 6) AS min_occupancy
    FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE 1 - l_discount < 0.9499999)
    GROUP BY l_orderkey""")
def reject_disordered(spark, sf_dir):
    sites = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("structure_id"), F.round(1 - F.col("l_discount"), 6).alias("occupancy"))
    return Q.reject_disordered(sites).groupBy("structure_id").agg(
        F.count(F.lit(1)).alias("n_sites"), F.round(F.min("occupancy"), 6).alias("min_occupancy"))


@query("majority_species", "elements", """
    SELECT l_orderkey AS structure_id, symbol, count(*) AS n FROM (
        SELECT l_orderkey, l_partkey, symbol, row_number() OVER (
            PARTITION BY l_orderkey, l_partkey ORDER BY round(1 - l_discount, 6) DESC, l_linenumber, symbol DESC) AS rn
        FROM lineitem JOIN elements ON zn = l_linenumber + 5) t
    WHERE rn = 1 GROUP BY 1, 2""")
def majority_species(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("zn", F.col("l_linenumber") + 5)
    sites = lines.join(F.broadcast(elements(spark)), "zn").select(
        F.col("l_orderkey").alias("structure_id"), "l_partkey", F.col("l_linenumber").alias("pos"), "symbol",
        F.round(1 - F.col("l_discount"), 6).alias("occupancy"))
    return G.majority_species(sites, ["structure_id", "l_partkey"]).groupBy("structure_id", "symbol").agg(
        F.count(F.lit(1)).alias("n"))


@query("class_weights", "element_sets", """
    , c AS (SELECT CAST(range AS INT) AS zn, coalesce(n, 0) AS n FROM range(1, 95)
            LEFT JOIN (SELECT zn AS k, count(*) AS n FROM element_sets GROUP BY zn) t ON k = range)
    SELECT zn, n, round(CASE WHEN n = 0 THEN 0.0 ELSE least(1 / sqrt(n) / (SELECT avg(1 / sqrt(n)) FROM c WHERE n > 0), 10.0) END, 6) AS weight
    FROM c""")
def class_weights(spark, sf_dir):
    return C.class_weights(element_sets_view(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def cooccurrence_tables(spark, sf_dir):
    members = symbols(spark, sf_dir)
    keyed = members.join(C.group_id(members, ["set_id"]).select("set_id", "gid"), "set_id").select("gid", "zn")
    return keyed.distinct()


add_view("gid_sets", "element_sets set_gid", """
    SELECT DISTINCT gid, zn FROM element_sets JOIN set_gid ON element_sets.set_id = set_gid.set_id""")
add_view("single_counts", "gid_sets", "SELECT zn, count(*) AS n FROM gid_sets GROUP BY zn")
add_view("pair_counts", "gid_sets", """
    SELECT a.zn AS z1, b.zn AS z2, count(*) AS n FROM gid_sets a JOIN gid_sets b ON a.gid = b.gid AND a.zn < b.zn GROUP BY 1, 2""")
add_view("pmi", "single_counts pair_counts gid_sets", """
    SELECT z1, z2, ln((coalesce(p.n, 0) + 2) / (k + 2 * 94 * 94.0)) - ln((coalesce(a.n, 0) + 2) / (k + 2 * 94.0))
           - ln((coalesce(b.n, 0) + 2) / (k + 2 * 94.0)) AS pmi
    FROM (SELECT CAST(x.range AS INT) AS z1, CAST(y.range AS INT) AS z2 FROM range(1, 95) x, range(1, 95) y) g
         CROSS JOIN (SELECT count(DISTINCT gid) AS k FROM gid_sets) n
         LEFT JOIN (SELECT z1 AS p1, z2 AS p2, n FROM pair_counts UNION ALL SELECT z2, z1, n FROM pair_counts) p
             ON p1 = z1 AND p2 = z2
         LEFT JOIN single_counts a ON a.zn = z1 LEFT JOIN single_counts b ON b.zn = z2""")


@query("cooccurrence", "single_counts pair_counts", """
    SELECT zn AS z1, zn AS z2, n FROM single_counts UNION ALL SELECT z1, z2, n FROM pair_counts""")
def cooccurrence(spark, sf_dir):
    singles, pairs = J.cooccurrence(cooccurrence_tables(spark, sf_dir))
    return singles.select(F.col("zn").alias("z1"), F.col("zn").alias("z2"), "n").unionByName(pairs)


def pmi_table(spark, sf_dir):
    sets = cooccurrence_tables(spark, sf_dir)
    singles, pairs = J.cooccurrence(sets)
    return J.pmi(singles, pairs, sets.agg(F.countDistinct("gid").alias("n_sets")))


@query("pmi", "pmi", "SELECT z1, z2, round(pmi, 6) AS pmi FROM pmi")
def pmi(spark, sf_dir):
    return pmi_table(spark, sf_dir).withColumn("pmi", F.round("pmi", 6))


@query("profile_hist", "elements", """
    , s AS (SELECT l_orderkey AS id, symbol, count(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey
            JOIN elements ON zn = CAST(substr(p_brand, 7) AS INT) GROUP BY 1, 2),
    f AS (SELECT id, sum(c) AS atoms, count(*) AS kinds FROM s GROUP BY id)
    SELECT 'n_atoms' AS metric, CAST(CAST(atoms AS BIGINT) AS VARCHAR) AS value, count(*) AS n FROM f GROUP BY 2
    UNION ALL SELECT 'n_distinct', CASE WHEN kinds < 5 THEN CAST(kinds AS VARCHAR) ELSE '5+' END, count(*) FROM f GROUP BY 2
    UNION ALL SELECT 'element', symbol, CAST(sum(c) AS BIGINT) FROM s GROUP BY 2
    UNION ALL SELECT 'frames_per_system', CASE WHEN k < 20 THEN CAST(k AS VARCHAR) ELSE '>=20' END, count(*)
              FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) t GROUP BY 2""")
def profile_hist(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("zn"))
    atoms = (table(spark, sf_dir, "lineitem").join(brands, F.col("l_partkey") == F.col("p_partkey"))
             .join(F.broadcast(elements(spark)), "zn").select(F.col("l_orderkey").alias("structure_id"), "symbol"))
    systems = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("system_id"), F.col("o_orderkey").alias("structure_id"))
    return C.profile(atoms, systems)


add_view("info", "", """
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'Lattice="20 0 0" ' END || 'energy=' || CAST(event_id AS VARCHAR)
           || CASE WHEN event_id % 7 = 0 THEN '' ELSE ' db_label=' || event_type || '_' || CAST(user_id AS VARCHAR) END AS info
    FROM events""")


def info_lines(spark, sf_dir):
    e = F.col("event_id")
    lattice = F.when(e % 11 == 0, "").otherwise('Lattice="20 0 0" ')
    label = F.when(e % 7 == 0, "").otherwise(F.concat(F.lit(" db_label="), "event_type", F.lit("_"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(lattice, F.lit("energy="), e.cast("string"), label).alias("info"))


@query("info_keys", "info", """
    SELECT key, count(*) AS n_present, (SELECT count(*) FROM info) AS n_total
    FROM (SELECT DISTINCT event_id, unnest(regexp_extract_all(info, '(\\w+)=', 1)) AS key FROM info) t GROUP BY key""")
def info_keys(spark, sf_dir):
    return C.completeness(C.parse_info(info_lines(spark, sf_dir)))


@query("info_labels", "", """
    SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS prefix, count(*) AS n,
           min(CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END) AS min_number,
           count(*) FILTER (WHERE event_id % 11 = 0) AS n_without_lattice
    FROM events GROUP BY 1""")
def info_labels(spark, sf_dir):
    return C.parse_info(info_lines(spark, sf_dir)).groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("min_number"),
        F.count_if(~F.array_contains("keys", "Lattice")).alias("n_without_lattice"))


@query("run_lengths", "", """
    WITH s AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
                      - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
    r AS (SELECT user_id, event_type, g, count(*) AS len FROM s GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY len) AS rn, count(*) OVER (PARTITION BY user_id) AS k FROM r)
    SELECT user_id, count(*) AS n_runs, round(avg(len), 6) AS mean, max(len) AS max,
           count(*) FILTER (WHERE len = 1) AS n_len1, max(len) FILTER (WHERE rn = k // 2 + 1) AS median
    FROM o GROUP BY user_id""")
def run_lengths(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return C.run_lengths(events, ["user_id"], "event_type", ["ts", "event_id"]).withColumn("mean", F.round("mean", 6))


@query("hist_percentiles", "", """
    SELECT lang, count(*) AS n, round(quantile_cont(n_chars, 0.05), 6) AS p5, round(quantile_cont(n_chars, 0.25), 6) AS p25,
           round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75,
           round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95,
           round(quantile_cont(n_chars, 0.99), 6) AS p99
    FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS n_chars FROM documents) d GROUP BY lang""")
def hist_percentiles(spark, sf_dir):
    hist = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    out = C.hist_percentiles(hist, ["lang"], "n_chars", "c")
    return out.select("lang", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("top_share", "", """
    WITH c AS (SELECT lang, source AS value, count(*) AS n FROM documents GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, value) AS rn, sum(n) OVER (PARTITION BY lang) AS a FROM c)
    SELECT lang, CASE WHEN rn <= 5 THEN value ELSE 'tail' END AS value, CAST(sum(n) AS BIGINT) AS n,
           CAST(least(min(rn), 6) AS INT) AS rank, round(sum(n) / max(a), 6) AS share
    FROM r GROUP BY lang, CASE WHEN rn <= 5 THEN value ELSE 'tail' END""")
def top_share(spark, sf_dir):
    return C.top_share(table(spark, sf_dir, "documents"), ["lang"], "source", 5).withColumn("share", F.round("share", 6))


@query("oversample", "", """
    SELECT source, count(*) AS n, CAST(sum(copy) AS BIGINT) AS sum_copy
    FROM (SELECT source, unnest(range(1, CASE source WHEN 'src1' THEN 4 WHEN 'src2' THEN 3 ELSE 2 END)) AS copy FROM documents) t
    GROUP BY source""")
def oversample(spark, sf_dir):
    mix = S.oversample(table(spark, sf_dir, "documents"), {"src1": 3, "src2": 2})
    return mix.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("copy").alias("sum_copy"))


@query("sample_frames", "", """
    WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
                      count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id, frame_index FROM f
    WHERE n <= 4 OR frame_index = n - 1
          OR frame_index IN (0, CAST(floor((n - 1) / 3.0::DOUBLE) AS BIGINT), CAST(floor(2.0 * ((n - 1) / 3.0::DOUBLE)) AS BIGINT))""")
def sample_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return S.sample_frames(frames, 4, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "frame_index")


@query("stride_limit", "", """
    SELECT user_id, event_id, row_index FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index FROM events) t
    WHERE row_index % 7 = 0 AND row_index < 21""")
def stride_limit(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return S.stride(frames, 7, ["user_id"], ["ts", "event_id"], limit=3).select("user_id", "event_id", "row_index")


@query("last_frame", "", """
    SELECT user_id, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1""")
def last_frame(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return S.last_row(frames, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("sample_n", "", """
    SELECT source, doc_id FROM (
        SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0|' || doc_id), doc_id) AS rn FROM documents) t
    WHERE rn <= 20""")
def sample_n(spark, sf_dir):
    return S.sample_n(table(spark, sf_dir, "documents").select("source", "doc_id"), 20, 0, ["doc_id"], ["source"])


@query("semi_filter", "", """
    SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source""")
def semi_filter(spark, sf_dir):
    flagged = table(spark, sf_dir, "labels").where("quality = 1")
    found = C.semi_filter(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), flagged, ["doc_id"])
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("scan_project_filter", "", """
    SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem
    WHERE l_linestatus = 'F' GROUP BY l_returnflag""")
def scan_project_filter(spark, sf_dir):
    from ..sources.store import read_structures_parquet
    scanned = read_structures_parquet(spark, [f"{sf_dir}/lineitem.parquet"], ["l_returnflag", "l_quantity"], "l_linestatus = 'F'")
    return scanned.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query("nearest_lookup", "elements", """
    SELECT p_partkey, CAST(rank AS INT) AS rank, symbol, round(diff, 8) AS diff FROM (
        SELECT p_partkey, symbol, abs(mass - m) AS diff, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(mass - m), zn) AS rank
        FROM (SELECT p_partkey, p_size * 4 + 0.3 AS m FROM part) p, elements) t WHERE rank <= 3""")
def nearest_lookup(spark, sf_dir):
    masses = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 4 + 0.3).alias("mass"))
    return C.nearest_lookup(masses, elements(spark)).select("p_partkey", "rank", "symbol", F.round("diff", 8).alias("diff"))


@query("twin_swap", "element_sets elements twins", """
    , k AS (SELECT set_id, symbol FROM element_sets JOIN elements ON element_sets.zn = elements.zn)
    SELECT structure_id, symbol, twin FROM (
        SELECT k.set_id AS structure_id, k.symbol, t.twin, row_number() OVER (PARTITION BY k.set_id ORDER BY k.symbol) AS rn
        FROM k JOIN twins t ON t.symbol = k.symbol
        WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.set_id = k.set_id AND o.symbol = t.twin)) x WHERE rn = 1""")
def twin_swap(spark, sf_dir):
    members = symbols(spark, sf_dir).withColumnRenamed("set_id", "structure_id")
    return C.twin_swap(members, twins(spark))


@query("win_rate", "", """
    SELECT swap, count(*) FILTER (WHERE t < s) AS wins, count(*) AS n, round(count(*) FILTER (WHERE t < s) / count(*), 6) AS rate
    FROM (SELECT source AS swap, quality AS s, toxic AS t FROM labels JOIN documents USING (doc_id)) p GROUP BY ROLLUP (swap)""")
def win_rate(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    scored = joined.select(F.col("source").alias("swap"), F.col("toxic").alias("f_true"), F.col("quality").alias("f_swap"))
    return P.win_rate(scored, "swap").withColumn("rate", F.round("rate", 6))


@query("repair_values", "", """
    SELECT vec_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_bad, round(sum(v), 4) AS total FROM (
        SELECT vec_id, i % 9 = 0 OR i % 10 = 0 OR i % 16 = 0 OR e * 50000 > 10000 AS bad,
               CASE WHEN i % 9 = 0 THEN 0 WHEN i % 10 = 0 THEN 10000 WHEN i % 16 = 0 THEN 0
                    ELSE least(greatest(e * 50000, 0), 10000) END AS v
        FROM (SELECT vec_id, d.i, CAST(embedding[d.i] AS DOUBLE) AS e FROM embeddings, (SELECT range AS i FROM range(1, 65)) d) x) y
    GROUP BY vec_id""")
def repair_values(spark, sf_dir):
    dirty = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("""
        transform(embedding, (e, i) -> CASE WHEN (i + 1) % 9 = 0 THEN double('NaN') WHEN (i + 1) % 10 = 0 THEN double('Infinity')
                  WHEN (i + 1) % 16 = 0 THEN double('-Infinity') ELSE CAST(e AS DOUBLE) * 50000 END)""").alias("values"))
    return C.repair_values(dirty, "values").select("vec_id", F.col("n_bad").cast("long").alias("n_bad"), F.round(
        F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))

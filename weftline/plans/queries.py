"""The reference queries over the driver's tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lift as L
from ..operators import post as P
from ..operators import prepare as R
from ..operators import synteny as S
from ..sources import adapters as A
from ..sources import text as T
from ..storage import fresh_path
from .workflow import Comparison, Species

RES, NEAR, FAR = A.RESOLUTION, 1_200_000, 10_000_000
THR, STEP, AGG = 5_000, 2_500, 80_000
FRAME, COARSE = 3, 80_000
SEED = "1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def comparison(spark: SparkSession, sf_dir: str, model: str = "raw") -> Comparison:
    n = A.n_bins(spark, sf_dir)
    a, b = (Species(A.bins(spark, n), A.pixels(spark, sf_dir, g, n), A.fai(spark, order, n)) for g, order in ((0, A.ORDER_A), (1, A.ORDER_B)))
    return Comparison(a, b, A.links(spark, sf_dir, n), RES, FAR, True, THR, STEP, AGG, model)


# ---- SQL: named parts, put together as needed

PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def with_parts(sql: str) -> str:
    """sql with the parts that it names, in their order, before it."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"\bp_\w+", text):
            if word in PARTS and word not in used:
                need(PARTS[word])
                used.append(word)

    need(sql)
    return ("WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in used) + "\n" if used else "") + sql


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = with_parts(sql)
        return f

    return keep


def _values(order: tuple[str, ...]) -> str:
    return f"SELECT chrom, ord, n // 4 * 40000 AS size FROM (VALUES {', '.join(f'({c!r}, {i + 1})' for i, c in enumerate(order))}) t(chrom, ord), p_n"


part("p_n", f"SELECT greatest({A.LEAST_BINS}, count(*)) // 4 * 4 AS n FROM part")
part("p_fai_a", _values(A.ORDER_A))
part("p_fai_b", _values(A.ORDER_B))
part("p_bins", "SELECT CAST(b AS INTEGER) AS bin_id, 'c' || CAST(b // per AS VARCHAR) AS chrom, b % per * 40000 AS start, b % per * 40000 + 40000 AS \"end\", CAST(CASE b % 7 WHEN 0 THEN 0.5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0.25 ELSE 1 END AS FLOAT) AS weight FROM (SELECT unnest(range(n)) AS b, n // 4 AS per FROM p_n)")
part("p_pixels", "SELECT CAST(l_linenumber % 2 AS INTEGER) AS g, CAST(least(u, v) AS INTEGER) AS bin1, CAST(greatest(u, v) AS INTEGER) AS bin2, CAST(sum(l_quantity) AS FLOAT) AS count FROM (SELECT *, (l_partkey * 7 + l_suppkey) % n AS u, (l_partkey * 7 + l_suppkey + l_orderkey * l_linenumber % 23) % n AS v FROM lineitem, p_n) GROUP BY ALL")
part("p_joined", """SELECT p.*, x.chrom AS chrom1, x.start AS start1, x."end" AS end1, y.chrom AS chrom2, y.start AS start2, y."end" AS end2,
  CAST(CAST(p.count AS DOUBLE) / CAST(x.weight * y.weight AS DOUBLE) AS FLOAT) AS val, CAST(CASE WHEN x.chrom = y.chrom THEN (y.start - x.start) // 40000 ELSE -1 END AS INTEGER) AS dist_bins
  FROM p_pixels p JOIN p_bins x ON p.bin1 = x.bin_id JOIN p_bins y ON p.bin2 = y.bin_id""")
part("p_near", "SELECT * FROM p_joined WHERE chrom1 = chrom2 AND start2 - start1 BETWEEN 0 AND 1200000")
part("p_values", "SELECT * FROM p_joined")


def coverage_sql(values: str) -> str:
    return f"SELECT g, bin_id, CAST(sum(CAST(count AS DOUBLE)) AS FLOAT) AS cov FROM (SELECT g, bin1 AS bin_id, count FROM {values} UNION ALL SELECT g, bin2, count FROM {values}) GROUP BY ALL"


def ranks_sql(values: str) -> str:
    whole = lambda x: f"CAST(least(trunc({x} * 100), 99) AS INTEGER)"
    return f"""SELECT g, dist_bins, val, {whole('(l + r) * CAST(0.5 AS DOUBLE) / n')} AS rank, {whole('l / n')} AS strict, {whole('r / n')} AS weak
  FROM (SELECT *, r - c AS l FROM (SELECT g, dist_bins, val, c, CAST(sum(c) OVER (PARTITION BY g, dist_bins ORDER BY val) AS DOUBLE) AS r, CAST(sum(c) OVER (PARTITION BY g, dist_bins) AS DOUBLE) AS n
  FROM (SELECT g, dist_bins, val, count(*) AS c FROM {values} GROUP BY ALL)))"""


part("p_cov", coverage_sql("p_values"))
part("p_ranks", ranks_sql("p_values"))
part("p_contacts", """SELECT v.g, chrom1, start1, end1, bin1, chrom2, start2, end2, bin2, rank, strict, weak, c1.cov AS cov1, c2.cov AS cov2, v.dist_bins
  FROM p_values v JOIN p_ranks r ON v.g = r.g AND v.dist_bins = r.dist_bins AND v.val = r.val JOIN p_cov c1 ON v.g = c1.g AND bin1 = c1.bin_id JOIN p_cov c2 ON v.g = c2.g AND bin2 = c2.bin_id""")
CONTACTS = "chrom1, start1, end1, bin1, chrom2, start2, end2, bin2, rank, strict, weak, cov1, cov2, dist_bins"


def maps(spark, sf_dir, genome):
    n = A.n_bins(spark, sf_dir)
    return A.bins(spark, n), A.pixels(spark, sf_dir, genome, n)


def links(spark, sf_dir):
    return A.links(spark, sf_dir, A.n_bins(spark, sf_dir))


def near(spark, sf_dir):
    return R.pixel_values(*maps(spark, sf_dir, 0), RES, max_distance=NEAR)


@query("bins", "SELECT bin_id, chrom, start, \"end\", weight FROM p_bins")
def bins(spark, sf_dir):
    return R.clean_bins(maps(spark, sf_dir, 0)[0])


@query("pixels_filtered", "SELECT bin1, bin2, count, dist_bins FROM p_near WHERE g = 0")
def pixels_filtered(spark, sf_dir):
    return near(spark, sf_dir).select("bin1", "bin2", "count", "dist_bins")


@query("pixel_value", "SELECT bin1, bin2, count, val, dist_bins FROM p_values WHERE g = 1")
def pixel_value(spark, sf_dir):
    return R.pixel_values(*maps(spark, sf_dir, 1), RES, max_distance=FAR, inter=True).select("bin1", "bin2", "count", "val", "dist_bins")


@query("coverage", f"SELECT bin_id, cov FROM ({coverage_sql('p_near')}) WHERE g = 0")
def coverage(spark, sf_dir):
    return R.coverage(near(spark, sf_dir))


@query("dist_ranks", f"SELECT dist_bins, val, rank, strict, weak FROM ({ranks_sql('p_near')}) WHERE g = 0")
def dist_ranks(spark, sf_dir):
    return R.value_ranks(near(spark, sf_dir))


@query("contacts", f"SELECT {CONTACTS} FROM p_contacts WHERE g = 0")
def contacts(spark, sf_dir):
    return R.contacts(*maps(spark, sf_dir, 0), RES, max_distance=FAR, inter=True)


@query("dist_stats", "SELECT dist_bins, count(*) AS n, round(quantile_cont(CAST(val AS DOUBLE), 0.05), 6) AS p05, round(quantile_cont(CAST(val AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(val AS DOUBLE), 0.95), 6) AS p95 FROM p_near WHERE g = 0 GROUP BY dist_bins")
def dist_stats(spark, sf_dir):
    return R.distance_stats(near(spark, sf_dir)).select("dist_bins", "n", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")))


@query("slice_medians", "SELECT dist_bins, CAST(i AS INTEGER) AS i, round(q, 6) AS q FROM (SELECT dist_bins, unnest(quantile_cont(CAST(val AS DOUBLE), [" + ", ".join(str((2 * i + 1) / 200) for i in range(100)) + "])) AS q, unnest(range(100)) AS i FROM p_near WHERE g = 0 GROUP BY dist_bins)")
def slice_medians(spark, sf_dir):
    return R.distance_stats(near(spark, sf_dir)).select("dist_bins", F.posexplode("medians").alias("i", "q")).withColumn("q", F.round("q", 6))


#: Weights without repeats: almost every value is a distance's only one.
part("p_own", "SELECT CAST(b AS INTEGER) AS bin_id, CAST(1 + b % 9973 / 9973.0::DOUBLE AS FLOAT) AS weight FROM (SELECT unnest(range(n)) AS b FROM p_n)")
part("p_own_values", """SELECT p.g, p.dist_bins, CAST(CAST(p.count AS DOUBLE) / CAST(CAST(x.weight AS DOUBLE) * CAST(y.weight AS DOUBLE) AS FLOAT) AS FLOAT) AS val FROM p_joined p JOIN p_own x ON p.bin1 = x.bin_id JOIN p_own y ON p.bin2 = y.bin_id""")


def balanced(spark, sf_dir):
    bins, pixels = maps(spark, sf_dir, 0)
    own = bins.withColumn("weight", (1 + F.col("bin_id") % 9973 / F.lit(9973.0)).cast("float"))
    return R.pixel_values(own, pixels, RES, max_distance=1 << 40, inter=True)


@query("balanced_ranks", f"SELECT dist_bins, rank, strict, weak, count(*) AS n FROM ({ranks_sql('p_own_values')}) WHERE g = 0 GROUP BY ALL")
def balanced_ranks(spark, sf_dir):
    return R.value_ranks(balanced(spark, sf_dir)).groupBy("dist_bins", "rank", "strict", "weak").agg(F.count("*").alias("n"))


@query("balanced_stats", "SELECT dist_bins, n, p05, CAST(i AS INTEGER) AS i, round(q, 4) AS q FROM (SELECT dist_bins, count(*) AS n, round(quantile_cont(CAST(val AS DOUBLE), 0.05), 4) AS p05, unnest(quantile_cont(CAST(val AS DOUBLE), [" + ", ".join(str((2 * i + 1) / 200) for i in range(100)) + "])) AS q, unnest(range(100)) AS i FROM p_own_values WHERE g = 0 GROUP BY dist_bins)")
def balanced_stats(spark, sf_dir):
    rows = R.distance_stats(balanced(spark, sf_dir)).select("dist_bins", "n", F.round("p05", 4).alias("p05"), F.posexplode("medians").alias("i", "q"))
    return rows.withColumn("q", F.round("q", 4))


# ---- synteny

part("p_links", """SELECT p_partkey AS line, 'c' || CAST(a // per AS VARCHAR) AS chrom_a, sa AS start_a, sa + len AS end_a, 'c' || CAST(b // per AS VARCHAR) AS chrom_b, CASE WHEN minus THEN sb + len ELSE sb END AS start_b, CASE WHEN minus THEN sb ELSE sb + len END AS end_b
  FROM (SELECT p_partkey, a, b, per, p_size % 3 = 0 AS minus, 200 + CAST(p_size AS BIGINT) * 2311 % 120000 AS len, a % per * 40000 + p_partkey * 1009 % 20000 AS sa, b % per * 40000 + p_partkey * 733 % 20000 AS sb
  FROM (SELECT *, n // 4 AS per, p_partkey * 37 % n AS a, (p_partkey * 37 + p_partkey % 7 * 3) % n AS b FROM part, p_n))""")
part("p_blocks", "SELECT *, row_number() OVER (ORDER BY line) AS blk, CASE WHEN end_b >= start_b THEN 1 ELSE -1 END AS dir FROM p_links")
part("p_gaps", """SELECT blk, 0 AS piece, chrom_a, pea AS start_a, start_a AS end_a, chrom_b, CASE WHEN pdir > 0 THEN peb ELSE start_b END AS start_b, CASE WHEN pdir > 0 THEN start_b ELSE peb END AS end_b, pdir AS dir, CAST(blk AS VARCHAR) || '_gap' AS tag
  FROM (SELECT *, lag(chrom_a) OVER w AS pa, lag(chrom_b) OVER w AS pb, lag(end_a) OVER w AS pea, lag(end_b) OVER w AS peb, lag(dir) OVER w AS pdir FROM p_blocks WINDOW w AS (ORDER BY line)) WHERE pa = chrom_a AND pb = chrom_b AND start_a - pea > 0""")
part("p_pieces", f"""SELECT blk, CAST(i + 1 AS INTEGER) AS piece, chrom_a, start_a + i * pa AS start_a, CASE WHEN i = k - 1 THEN end_a ELSE start_a + (i + 1) * pa END AS end_a, chrom_b,
  CASE WHEN NOT cut THEN start_b WHEN dir > 0 THEN start_b + i * pb WHEN i = k - 1 THEN end_b ELSE start_b - (i + 1) * pb END AS start_b,
  CASE WHEN NOT cut THEN end_b WHEN dir < 0 THEN start_b - i * pb WHEN i = k - 1 THEN end_b ELSE start_b + (i + 1) * pb END AS end_b, dir, CAST(blk AS VARCHAR) AS tag
  FROM (SELECT *, (end_a - start_a) // k AS pa, abs(end_b - start_b) // k AS pb, unnest(range(k)) AS i FROM (SELECT *, end_a - start_a > {THR} AS cut, CASE WHEN end_a - start_a > {THR} THEN greatest(1, (end_a - start_a) // {STEP}) ELSE 1 END AS k FROM p_blocks))""")
MARK = "blk, piece, chrom_a, start_a, end_a, chrom_b, start_b, end_b, dir, tag"
part("p_mark", f"SELECT {MARK} FROM p_gaps UNION ALL SELECT {MARK} FROM p_pieces")
LINK = "line, chrom_a, start_a, end_a, chrom_b, start_b, end_b"


@query("paf_to_link", f"SELECT {LINK} FROM p_links WHERE (end_a - start_a) % 1000 >= 300")
def paf_to_link(spark, sf_dir):
    return S.paf_to_link(A.paf(spark, sf_dir, A.n_bins(spark, sf_dir)), 300)


@query("link_gaps", f"SELECT {MARK} FROM p_gaps")
def link_gaps(spark, sf_dir):
    return S.gaps(links(spark, sf_dir))


@query("link_densify", f"SELECT {MARK} FROM p_pieces")
def link_densify(spark, sf_dir):
    return S.densify(links(spark, sf_dir), thr_len=THR, step_len=STEP)


@query("link_mark", f"SELECT {MARK} FROM p_mark")
def link_mark(spark, sf_dir):
    return S.link_to_mark(links(spark, sf_dir), thr_len=THR, step_len=STEP)


@query("link_plain", f"SELECT blk, chrom_a, start_a, end_a, chrom_b, start_b, end_b, dir, CAST(blk AS VARCHAR) AS tag FROM p_blocks")
def link_plain(spark, sf_dir):
    return S.link_to_mark(links(spark, sf_dir), dense=False, gap=False).drop("piece")


part("p_bed", "SELECT 'chrc' || CAST(p_partkey % 4 AS VARCHAR) AS chrom, p_partkey * 7919 % 2000000 AS start, p_partkey * 7919 % 2000000 + 100 + p_partkey * 131 % 900 AS \"end\", 'n' || CAST(p_partkey AS VARCHAR) AS name FROM part")


@query("rough_lift", """SELECT fb.chrom, c.cb * 200 AS start, c.cb * 200 + 199 AS "end", name FROM (SELECT substr(chrom, 4) AS chrom, name, unnest(range(start // 200, "end" // 200 + 1)) AS ca FROM p_bed) d
  JOIN (SELECT DISTINCT chrom_a, (start_a + end_a) // 400 AS ca, chrom_b, (start_b + end_b) // 400 AS cb FROM p_mark) c ON d.chrom = c.chrom_a AND d.ca = c.ca JOIN p_fai_b fb ON fb.chrom = c.chrom_b""")
def rough_lift(spark, sf_dir):
    n = A.n_bins(spark, sf_dir)
    return S.rough_lift(A.bed(spark, sf_dir), S.link_to_mark(A.links(spark, sf_dir, n), thr_len=THR, step_len=STEP), A.fai(spark, A.ORDER_A, n), A.fai(spark, A.ORDER_B, n))


# ---- lift

for g, x in ((0, "a"), (1, "b")):
    part(f"p_obs_{x}", f"SELECT DISTINCT bin, chrom, start, \"end\" FROM (SELECT bin1 AS bin, chrom1 AS chrom, start1 AS start, end1 AS \"end\" FROM p_contacts WHERE g = {g} UNION ALL SELECT bin2, chrom2, start2, end2 FROM p_contacts WHERE g = {g})")
    part(f"p_canon_{x}", f"""SELECT CASE WHEN swap THEN o2 ELSE o1 END AS n1, CASE WHEN swap THEN bin2 ELSE bin1 END AS b1, CASE WHEN swap THEN o1 ELSE o2 END AS n2, CASE WHEN swap THEN bin1 ELSE bin2 END AS b2, rank, strict, weak, CASE WHEN swap THEN cov1 ELSE cov2 END AS cov2
  FROM (SELECT c.*, x.ord AS o1, y.ord AS o2, y.ord < x.ord OR (y.ord = x.ord AND bin2 < bin1) AS swap FROM p_contacts c JOIN p_fai_{x} x ON chrom1 = x.chrom JOIN p_fai_{x} y ON chrom2 = y.chrom WHERE g = {g})""")
part("p_remap", """SELECT fa.ord AS na, oa.bin AS ba, fb.ord AS nb, ob.bin AS bb, min(blk * 100000 + piece) AS first_line FROM p_mark m JOIN p_fai_a fa ON chrom_a = fa.chrom JOIN p_fai_b fb ON chrom_b = fb.chrom
  JOIN p_obs_a oa ON oa.chrom = chrom_a AND (start_a + end_a) // 2 >= oa.start AND (start_a + end_a) // 2 < oa."end" JOIN p_obs_b ob ON ob.chrom = chrom_b AND (start_b + end_b) // 2 >= ob.start AND (start_b + end_b) // 2 < ob."end" GROUP BY ALL""")
SHARE = "CASE WHEN {n} = 8 THEN 12 ELSE (200 + {n}) // (2 * {n}) END"
part("p_runs", """SELECT *, sum(fresh) OVER (PARTITION BY na, ba ORDER BY line_c, nb, bb) - 1 AS j FROM (SELECT *, CASE WHEN bb - lag(bb) OVER (PARTITION BY na, ba, nb ORDER BY bb) <= 2 THEN 0 ELSE 1 END AS fresh, min(line_b) OVER (PARTITION BY na, ba, nb) AS line_c
  FROM (SELECT *, min(first_line) OVER (PARTITION BY nb, bb) AS line_b, count(*) OVER (PARTITION BY nb, bb) AS sources FROM p_remap))""")
part("p_groups", f"SELECT na, ba, CAST(j AS INTEGER) AS j, nb, bb, CAST({SHARE.format(n='count(*) OVER (PARTITION BY na, ba, j)')} AS INTEGER) AS share100, CAST({SHARE.format(n='sources')} AS INTEGER) AS w100 FROM p_runs")
part("p_pairs", """SELECT x.*, t.rank AS b_rank, t.strict AS b_strict, t.weak AS b_weak, CAST(t.cov2 AS BIGINT) AS b_cov2, t.rank IS NOT NULL AS hit FROM (SELECT a.*, u.j AS j1, v.j AS j2, u.share100::BIGINT * u.w100 * v.share100 * v.w100 AS base,
  CASE WHEN (u.nb, u.bb) <= (v.nb, v.bb) THEN u.nb ELSE v.nb END AS ln, CASE WHEN (u.nb, u.bb) <= (v.nb, v.bb) THEN u.bb ELSE v.bb END AS lb, CASE WHEN (u.nb, u.bb) <= (v.nb, v.bb) THEN v.nb ELSE u.nb END AS hn, CASE WHEN (u.nb, u.bb) <= (v.nb, v.bb) THEN v.bb ELSE u.bb END AS hb
  FROM p_canon_a a JOIN p_groups u ON a.n1 = u.na AND a.b1 = u.ba JOIN p_groups v ON a.n2 = v.na AND a.b2 = v.ba) x LEFT JOIN p_canon_b t ON t.n1 = ln AND t.b1 = lb AND t.n2 = hn AND t.b2 = hb""")
part("p_sums", """SELECT n1, b1, n2, b2, j1, j2, rank, strict, weak, sum(base * b_rank)::BIGINT AS s_rank, sum(base * b_strict)::BIGINT AS s_strict, sum(base * b_weak)::BIGINT AS s_weak, sum(base * b_cov2)::BIGINT AS s_cov2, sum(base)::BIGINT AS s_base,
  list_sort(list_distinct(list((ln, lb)))) AS set_lo, list_sort(list_distinct(list((hn, hb)))) AS set_hi FROM p_pairs WHERE hit GROUP BY ALL HAVING sum(base) > 0""")


def label_sql(s: str) -> str:
    one = lambda i: f"(SELECT chrom || ':' || CAST(start AS VARCHAR) FROM p_obs_b WHERE bin = {s}[{i}][2])"
    return f"CASE WHEN len({s}) = 2 THEN {one(1)} || '-' || {one(2)} ELSE {one(1)} END"


def even_sql(num: str, den: str) -> str:
    """num / den rounded to a whole number, ties to even, in whole numbers."""
    return f"(({num}) // ({den}) + CASE WHEN 2 * (({num}) % ({den})) > ({den}) OR (2 * (({num}) % ({den})) = ({den}) AND ({num}) // ({den}) % 2 = 1) THEN 1 ELSE 0 END)"


def candidates_sql(norm: str, cents: str) -> str:
    unit = "100000000"
    return f"""SELECT n1, b1, n2, b2, j1, j2, {label_sql('set_lo')} AS remap1, {label_sql('set_hi')} AS remap2, rank AS obs, CAST({even_sql('s_rank', norm)} AS INTEGER) AS ctrl, CAST(greatest(weak - rank, rank - strict) AS INTEGER) AS dev_obs,
  CAST({even_sql('greatest(s_weak - s_rank, s_rank - s_strict)', unit)} AS INTEGER) AS dev_ctrl, strict AS obs_strict, weak AS obs_weak, CAST({even_sql('s_strict', norm)} AS INTEGER) AS ctrl_strict, CAST({even_sql('s_weak', norm)} AS INTEGER) AS ctrl_weak,
  CAST({cents} AS DOUBLE) / 100 AS ctrl_cov2, CAST({even_sql('s_base', '1000')} AS DOUBLE) / 100000 AS coverage FROM p_sums"""


part("p_cands", candidates_sql("100000000", even_sql("s_cov2", "1000000")))
part("p_cands_balanced", candidates_sql("s_base", even_sql("s_cov2::HUGEINT * 100", "s_base")))


def best_sql(order: str, cands: str = "p_cands") -> str:
    return f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY n1, b1, n2, b2 ORDER BY {order}) AS k FROM {cands}) WHERE k = 1"


ORDERS = {"coverage": "ctrl_cov2 * ctrl_weak, j1 DESC, j2 DESC", "deviation": "dev_ctrl, j1 DESC, j2 DESC", "length": "ctrl_cov2, j1 DESC, j2 DESC", "none": "j1, j2", "default": "coverage, j1 DESC, j2 DESC"}


def rows_sql(best: str) -> str:
    return f"""SELECT x.chrom AS chr1_observed, x.start AS pos1_observed, y.chrom AS chr2_observed, y.start AS pos2_observed, remap1 AS remap1_control, remap2 AS remap2_control, obs AS observed_contacts, ctrl AS control_contacts, dev_obs AS observed_deviations, dev_ctrl AS control_deviations,
  obs_strict AS observed_coverages_pos1, obs_weak AS observed_coverages_pos2, ctrl_strict AS control_coverages_pos1, ctrl_weak AS control_coverages_pos2, ctrl_cov2 AS control_contact_distances, coverage AS remapping_coverages, n1, n2, b1, b2
  FROM ({best}) t JOIN p_obs_a x ON x.bin = b1 JOIN p_obs_a y ON y.bin = b2"""


part("p_rows", rows_sql(best_sql(ORDERS["default"])))
CANDS = "n1, b1, n2, b2, j1, j2, remap1, remap2, obs, ctrl, dev_obs, dev_ctrl, obs_strict, obs_weak, ctrl_strict, ctrl_weak, ctrl_cov2, coverage"


@query("remap_pairs", "SELECT na, ba, nb, bb FROM p_remap")
def remap_pairs(spark, sf_dir):
    return comparison(spark, sf_dir).lift().remap.drop("first_line")


@query("remap_groups", "SELECT na, ba, j, nb, bb, share100, w100 FROM p_groups")
def remap_groups(spark, sf_dir):
    return comparison(spark, sf_dir).lift().groups


@query("lift_candidates", f"SELECT {CANDS} FROM p_cands")
def lift_candidates(spark, sf_dir):
    return comparison(spark, sf_dir).lift().candidates


@query("lift_balanced", f"SELECT {CANDS} FROM p_cands_balanced")
def lift_balanced(spark, sf_dir):
    return comparison(spark, sf_dir, "balanced").lift().candidates


def _best(criterion: str):
    @query(f"lift_best_{criterion}", f"SELECT {CANDS} FROM ({best_sql(ORDERS[criterion])})")
    def run(spark, sf_dir):
        return L.choose_best(comparison(spark, sf_dir).lift().candidates, criterion)


for c in L.CRITERIA:
    _best(c)


@query("lift_rows", "SELECT * EXCLUDE (n1, n2, b1, b2) FROM p_rows")
def lift_rows(spark, sf_dir):
    return comparison(spark, sf_dir).lift().rows().drop("line")


@query("lift_losers", f"SELECT {CANDS} FROM p_cands ANTI JOIN ({best_sql(ORDERS['default'])}) t USING (n1, b1, n2, b2, j1, j2)")
def lift_losers(spark, sf_dir):
    return comparison(spark, sf_dir).lift().losers().select(*CANDS.split(", "))


part("p_mapped", "SELECT na AS n, ba AS b, max(j) + 1 AS groups FROM p_groups GROUP BY ALL")
part("p_able", "SELECT a.* FROM p_canon_a a SEMI JOIN p_mapped x ON a.n1 = x.n AND a.b1 = x.b SEMI JOIN p_mapped y ON a.n2 = y.n AND a.b2 = y.b")
for name, src in (("all", "p_canon_a"), ("able", "p_able"), ("hit", "(SELECT * FROM p_pairs WHERE hit)"), ("missed", "(SELECT * FROM p_pairs WHERE NOT hit)")):
    part(f"p_ends_{name}", f"SELECT DISTINCT n, b FROM (SELECT n1 AS n, b1 AS b FROM {src} t UNION ALL SELECT n2, b2 FROM {src} t)")
part("p_lost", "SELECT * FROM p_ends_missed ANTI JOIN p_ends_hit USING (n, b)")
part("p_kept", "SELECT e.*, groups FROM p_ends_able e JOIN p_mapped USING (n, b) ANTI JOIN p_lost USING (n, b)")
part("p_per", "SELECT n1, b1, n2, b2, count(*) AS c FROM p_cands GROUP BY ALL")


LIFT_STAT = """SELECT 'all' AS name, (SELECT count(*) FROM p_canon_a) AS contacts, (SELECT count(*) FROM p_ends_all) AS bins UNION ALL SELECT 'remappable', (SELECT count(*) FROM p_able), (SELECT count(*) FROM p_ends_able)
  UNION ALL SELECT 'processed', (SELECT count(*) FROM (SELECT DISTINCT n1, b1, n2, b2 FROM p_pairs WHERE hit)), (SELECT count(*) FROM p_ends_hit) UNION ALL SELECT 'unique', (SELECT count(*) FROM p_per WHERE c = 1), (SELECT count(*) FROM p_kept WHERE groups = 1)
  UNION ALL SELECT 'duplicated', (SELECT count(*) FROM p_per WHERE c > 1), (SELECT count(*) FROM p_kept WHERE groups > 1) UNION ALL SELECT 'dropped', (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM p_per), (SELECT count(*) FROM p_lost)"""


@query("lift_stat", LIFT_STAT)
def lift_stat(spark, sf_dir):
    return comparison(spark, sf_dir).lift().stat()


# ---- files: written, then read again; place is a row's number in the order of the file


def again(spark, write, read) -> DataFrame:
    path = fresh_path(spark, "file")
    write(path)
    return T.placed(read(spark, path))


@query("contacts_file", f"SELECT row_number() OVER (ORDER BY dist_bins = -1, dist_bins, bin1, bin2) AS place, {CONTACTS} FROM p_contacts WHERE g = 0")
def contacts_file(spark, sf_dir):
    return again(spark, lambda path: T.write_contacts(R.contacts(*maps(spark, sf_dir, 0), RES, max_distance=FAR, inter=True), path), T.read_contacts)


@query("mark_file", "SELECT row_number() OVER (ORDER BY blk, piece) AS place, chrom_a, start_a, end_a, chrom_b, start_b, end_b, dir, tag FROM p_mark")
def mark_file(spark, sf_dir):
    return again(spark, lambda path: T.write_mark(S.link_to_mark(links(spark, sf_dir), thr_len=THR, step_len=STEP), path), T.read_mark)


@query("lift_file", f"SELECT row_number() OVER (ORDER BY n1, n2, b1, b2) AS place, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if T.LIFT_COLUMNS.index(c) > 5 else c for c in T.LIFT_COLUMNS)} FROM p_rows")
def lift_file(spark, sf_dir):
    return again(spark, lambda path: T.write_lift(comparison(spark, sf_dir).rows(), path), T.read_lift)


@query("stat_file", "SELECT list_position(['all', 'remappable', 'processed', 'unique', 'duplicated', 'dropped'], name) AS place, * FROM (" + LIFT_STAT + ")")
def stat_file(spark, sf_dir):
    return again(spark, lambda path: T.write_stat(comparison(spark, sf_dir).lift().stat(), path), T.read_stat)


#: A third of the contacts come a second time, at the end of the file, with the bins the other way round and other values.
part("p_twice", """SELECT o1, bin1, o2, bin2, again, CASE WHEN again THEN weak ELSE rank END AS rank, strict, CASE WHEN again THEN rank ELSE weak END AS weak, CASE WHEN again THEN cov1 + 1 ELSE cov1 END AS cov1, CASE WHEN again THEN cov2 + 2 ELSE cov2 END AS cov2
  FROM (SELECT c.*, x.ord AS o1, y.ord AS o2, bin1 % 3 = 0 AND bin1 <> bin2 AS again FROM p_contacts c JOIN p_fai_a x ON chrom1 = x.chrom JOIN p_fai_a y ON chrom2 = y.chrom WHERE g = 0)""")


@query("contacts_last_line", """SELECT CASE WHEN s THEN o2 ELSE o1 END AS n1, CASE WHEN s THEN bin2 ELSE bin1 END AS b1, CASE WHEN s THEN o1 ELSE o2 END AS n2, CASE WHEN s THEN bin1 ELSE bin2 END AS b2, rank, strict, weak, CASE WHEN s THEN cov2 ELSE cov1 END AS cov1, CASE WHEN s THEN cov1 ELSE cov2 END AS cov2
  FROM (SELECT *, o2 < o1 OR (o1 = o2 AND bin2 < bin1) AS s FROM p_twice)""")
def contacts_last_line(spark, sf_dir):
    rows = R.contacts(*maps(spark, sf_dir, 0), RES, max_distance=FAR, inter=True).withColumn("late", F.lit(0))
    other = {f"{c}{k}": F.col(f"{c}{3 - k}") for c in ("chrom", "start", "end", "bin") for k in (1, 2)}
    late = rows.where("bin1 % 3 = 0 and bin1 != bin2").withColumns(other | {"rank": F.col("weak"), "weak": F.col("rank"), "cov1": F.col("cov1") + 1, "cov2": F.col("cov2") + 2, "late": F.lit(1)})
    path = fresh_path(spark, "file")
    T.write_rows(rows.union(late.select(*rows.columns)).orderBy("late", "bin1", "bin2").select(*T.CONTACT_COLUMNS), path, header=True)
    return L.canonical(T.read_contacts(spark, path), A.fai(spark, A.ORDER_A, A.n_bins(spark, sf_dir)))


# ---- after the lift


def dedup_sql(res: int) -> str:
    return f"""SELECT chrom1, b1, chrom2, b2, obs, ctrl, dev_obs, dev_ctrl, l FROM (SELECT *, row_number() OVER (PARTITION BY chrom1, b1, chrom2, b2 ORDER BY l, n1 DESC, n2 DESC, i1 DESC, i2 DESC) AS k FROM (SELECT CASE WHEN s THEN chr2_observed ELSE chr1_observed END AS chrom1, CASE WHEN s THEN p2 ELSE p1 END AS b1,
  CASE WHEN s THEN chr1_observed ELSE chr2_observed END AS chrom2, CASE WHEN s THEN p1 ELSE p2 END AS b2, CAST(observed_contacts AS DOUBLE) AS obs, CAST(control_contacts AS DOUBLE) AS ctrl, CAST(observed_deviations AS DOUBLE) AS dev_obs, CAST(control_deviations AS DOUBLE) AS dev_ctrl, control_contact_distances AS l, n1, n2, i1, i2
  FROM (SELECT * EXCLUDE (b1, b2), b1 AS i1, b2 AS i2, pos1_observed // {res} AS p1, pos2_observed // {res} AS p2, n2 < n1 OR (n1 = n2 AND pos2_observed // {res} < pos1_observed // {res}) AS s FROM p_rows))) WHERE k = 1"""


part("p_dedup", dedup_sql(RES))
part("p_anchors", "SELECT DISTINCT chrom, bin FROM (SELECT chrom1 AS chrom, b1 AS bin FROM p_dedup UNION ALL SELECT chrom2, b2 FROM p_dedup)")


def windows_sql(contacts: str) -> str:
    return f"SELECT a.chrom, a.bin, obs, ctrl FROM {contacts} c JOIN p_anchors a ON c.chrom1 = a.chrom AND c.chrom2 = a.chrom AND c.b1 >= a.bin - {FRAME} AND c.b2 <= a.bin + {FRAME}"


part("p_windows", windows_sql("p_dedup"))
part("p_shuffled", f"""SELECT x.* EXCLUDE (ctrl, i), y.ctrl FROM (SELECT *, row_number() OVER (ORDER BY chrom1, b1, chrom2, b2) AS i FROM p_dedup) x
  JOIN (SELECT ctrl, row_number() OVER (ORDER BY md5('{SEED}|' || chrom1 || '|' || b1 || '|' || chrom2 || '|' || b2)) AS i FROM p_dedup) y USING (i)""")
LOG = "avg(log10(greatest(obs, 1e-6) / greatest(ctrl, 1e-6)))"
FAR_FROM = "least(greatest(1.0::DOUBLE - abs({p} - 50) / 50.0, 0.01), 0.99)"
PBAD = f"avg(-(abs(obs - ctrl) / 100.0) * log10({FAR_FROM.format(p='obs')} * {FAR_FROM.format(p='ctrl')}))"


def metric_sql(value: str, rows: str = "p_windows", threshold: float = FRAME**2) -> str:
    return f"SELECT chrom, bin * {RES} AS start, (bin + 1) * {RES} - 1 AS \"end\", {value} AS value FROM {rows} GROUP BY chrom, bin HAVING count(*) > {threshold}"


def rounded(sql: str) -> str:
    return f'SELECT chrom, start, "end", round(value, 6) + 0.0::DOUBLE AS value FROM ({sql})'


MEAN_RANK = "rank() OVER (PARTITION BY chrom, bin ORDER BY {c}) + (count(*) OVER (PARTITION BY chrom, bin, {c}) - 1) / 2"
RANKED = f"(SELECT chrom, bin, {MEAN_RANK.format(c='obs')} AS x, {MEAN_RANK.format(c='ctrl')} AS y FROM p_windows)"
CORR = "CASE WHEN var_pop({x}) * var_pop({y}) = 0 THEN 'nan'::DOUBLE ELSE covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"
STRIPES = f"(SELECT chrom2 AS chrom, b2 AS bin, obs, ctrl FROM p_dedup WHERE chrom1 = chrom2 AND b2 - b1 <= {FRAME})"
METRIC_SQL = {
    "pbad": metric_sql(PBAD),
    "log": metric_sql(LOG),
    "stripe": metric_sql(LOG, STRIPES, 0.4 * FRAME),
    "pearsone": metric_sql(CORR.format(x="obs", y="ctrl")),
    "spearman": metric_sql(CORR.format(x="x", y="y"), RANKED),
}
part("p_pbad", metric_sql(PBAD))


def _round_value(df: DataFrame) -> DataFrame:
    """Rounded, a negative zero as zero."""
    return df.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _metric(name: str):
    @query(f"metric_{name}", rounded(METRIC_SQL[name]))
    def run(spark, sf_dir):
        return _round_value(P.metric(comparison(spark, sf_dir).dedup(), RES, frame=FRAME, name=name))


for m in P.METRICS:
    _metric(m)


@query("lift_dedup", dedup_sql(COARSE))
def lift_dedup(spark, sf_dir):
    return comparison(spark, sf_dir).dedup(COARSE)


part("p_widths", "SELECT abs(CAST(split_part(split_part(t, '-', 2), ':', 2) AS BIGINT) - CAST(split_part(split_part(t, '-', 1), ':', 2) AS BIGINT)) AS w FROM (SELECT remap1_control AS t FROM p_rows UNION ALL SELECT remap2_control FROM p_rows) WHERE contains(t, '-')")


@query("lift_resolution", """SELECT CAST(CASE WHEN g IS NULL THEN 40000 WHEN g < 1000 AND w IS NOT NULL THEN CASE WHEN w < 1000 THEN 10000 ELSE w END WHEN g < 1000 THEN 10000 ELSE g END AS BIGINT) AS resolution FROM (SELECT list_reduce(list(v), lambda a, b: gcd(a, b)) AS g FROM (
  SELECT DISTINCT v FROM (SELECT p - min(p) OVER (PARTITION BY c) AS v FROM (SELECT chr1_observed AS c, pos1_observed AS p FROM p_rows UNION ALL SELECT chr2_observed, pos2_observed FROM p_rows) UNION ALL SELECT w FROM p_widths) WHERE v > 0)) CROSS JOIN (SELECT mode(w) AS w FROM p_widths)""")
def lift_resolution(spark, sf_dir):
    return P.infer_resolution(comparison(spark, sf_dir).rows())


@query("resolution_by_labels", "SELECT CAST(CASE WHEN max(p_size) > 1 THEN 5000 ELSE 40000 END AS BIGINT) AS resolution FROM part")
def resolution_by_labels(spark, sf_dir):
    """Positions have no common step, so the most frequent width of labels counts, which is below the default's least."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("c").alias("chr1_observed"), (k * 7).alias("pos1_observed"), F.lit("c").alias("chr2_observed"), (k * 11 + 3).alias("pos2_observed"), F.concat(F.lit("c:0-c:"), F.when(k % 5 == 0, 2000).otherwise(5000)).alias("remap1_control"), F.lit("c:1").alias("remap2_control"))
    return P.infer_resolution(rows)


LOCI = [("c0", 0, 800_000), ("c2", 400_000, 1_200_000), ("c3", 0, 2_000_000)]


@query("metric_loci", rounded(f"""SELECT d.chrom, d.start, d."end", {PBAD} AS value FROM (VALUES {', '.join(f'({c!r}, {s}, {e})' for c, s, e in LOCI)}) d(chrom, start, "end") JOIN p_dedup c ON c.chrom1 = d.chrom AND c.chrom2 = d.chrom AND c.b1 BETWEEN d.start // {RES} AND d."end" // {RES} AND c.b2 BETWEEN d.start // {RES} AND d."end" // {RES} GROUP BY ALL"""))
def metric_loci(spark, sf_dir):
    loci = spark.createDataFrame(LOCI, "chrom string, start long, end long")
    return _round_value(P.metric_loci(comparison(spark, sf_dir).dedup_within(*LOCI), loci, RES)).select("chrom", "start", "end", "value")


@query("bedgraph", f"SELECT * FROM ({rounded(METRIC_SQL['log'])})")
def bedgraph(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return _round_value(P.ordered_bedgraph(P.metric(c.dedup(), RES, frame=FRAME, name="log"), c.a.fai))


@query("bedgraph_file", f"SELECT row_number() OVER (ORDER BY ord, start, \"end\") AS place, chrom, start, \"end\", round(value, 6) + 0.0::DOUBLE AS value FROM ({METRIC_SQL['log']}) JOIN p_fai_a USING (chrom)")
def bedgraph_file(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return _round_value(again(spark, lambda path: T.write_rows(P.ordered_bedgraph(P.metric(c.dedup(), RES, frame=FRAME, name="log"), c.a.fai), path), T.read_bedgraph))


@query("shuffle_control", "SELECT chrom1, b1, chrom2, b2, obs, ctrl, dev_obs, dev_ctrl, l FROM p_shuffled")
def shuffle_control(spark, sf_dir):
    return P.shuffled_contacts(comparison(spark, sf_dir).dedup(), SEED)


@query("metric_control", rounded(metric_sql(LOG, f"({windows_sql('p_shuffled')})")))
def metric_control(spark, sf_dir):
    return _round_value(P.metric(P.shuffled_contacts(comparison(spark, sf_dir).dedup().select("chrom1", "b1", "chrom2", "b2", "obs", "ctrl"), SEED), RES, frame=FRAME, name="log"))


def hist_sql(v: str, lo: float, hi: float, n: int) -> str:
    step = (hi - lo) / n
    k0 = f"least(CAST(floor(({v} - {lo!r}::DOUBLE) / {step!r}::DOUBLE) AS BIGINT), {n - 1})"
    edge = lambda k: f"CASE WHEN {k} = {n} THEN {float(hi)!r}::DOUBLE ELSE {k} * {step!r}::DOUBLE + {float(lo)!r}::DOUBLE END"
    k1 = f"({k0} - CASE WHEN {v} < {edge(k0)} THEN 1 ELSE 0 END)"
    return f"CASE WHEN {v} >= {lo} AND {v} <= {hi} THEN CAST({k1} + CASE WHEN {k1} < {n - 1} AND {v} >= {edge(f'({k1} + 1)')} THEN 1 ELSE 0 END AS INTEGER) END"


def hist2d_sql(rows: str, x: str, y: str, lo: float, hi: float, n: int) -> str:
    area = ((hi - lo) / n) * ((hi - lo) / n)
    return f"SELECT ix, iy, c / (sum(c) OVER () * {area!r}::DOUBLE) AS d FROM (SELECT ix, iy, count(*) AS c FROM (SELECT {hist_sql('hx', lo, hi, n)} AS ix, {hist_sql('hy', lo, hi, n)} AS iy FROM (SELECT {x} AS hx, {y} AS hy FROM {rows})) WHERE ix IS NOT NULL AND iy IS NOT NULL GROUP BY ALL)"


def map_sql(observed: str, control: str, n: int) -> str:
    ratio = "log2((greatest(coalesce(o.d, 0), 0) + 1e-9) / (greatest(coalesce(c.d, 0), 0) + 1e-9))"
    return f"SELECT g.ix, g.iy, round(coalesce(o.d, 0), 6) AS observed, round(coalesce(c.d, 0), 6) AS control, round({ratio}, 6) AS log2_ratio FROM (SELECT CAST(i // {n} AS INTEGER) AS ix, CAST(i % {n} AS INTEGER) AS iy FROM range({n * n}) t(i)) g LEFT JOIN ({observed}) o USING (ix, iy) LEFT JOIN ({control}) c USING (ix, iy)"


def permuted(rows: str, column: str) -> str:
    locus = ", ".join(P.LOCUS)
    line = f"'{SEED}|' || " + " || '|' || ".join(P.LOCUS)
    return f"(SELECT x.* EXCLUDE ({column}, i), y.{column} FROM (SELECT *, row_number() OVER (ORDER BY {locus}) AS i FROM {rows}) x JOIN (SELECT {column}, row_number() OVER (ORDER BY md5({line})) AS i FROM {rows}) y USING (i))"


GRID = 50
MAP_SQL: dict[str, str] = {}
part("p_band", f"SELECT CAST(observed_contacts AS DOUBLE) AS obs, CAST(control_contacts AS DOUBLE) AS ctrl, {', '.join(P.LOCUS)} FROM p_rows WHERE n1 = n2 AND abs(pos2_observed // {RES} - pos1_observed // {RES}) BETWEEN 1 AND 20")
token_pos = lambda t: f"CASE WHEN contains({t}, '-') THEN (CAST(split_part(split_part({t}, '-', 1), ':', 2) AS BIGINT) + CAST(split_part(split_part({t}, '-', 2), ':', 2) AS BIGINT)) // 2 ELSE CAST(split_part({t}, ':', 2) AS BIGINT) END"
token_chrom = lambda t: f"CASE WHEN contains({t}, '-') AND split_part(split_part({t}, '-', 1), ':', 1) <> split_part(split_part({t}, '-', 2), ':', 1) THEN NULL ELSE split_part({t}, ':', 1) END"
part("p_dist", f"""SELECT CAST(observed_contacts AS DOUBLE) AS obs, CAST(control_contacts AS DOUBLE) AS ctrl, {', '.join(P.LOCUS)}, least(greatest(abs(pos2_observed - pos1_observed) / 1e6, 0), 5) AS da,
  least(greatest(CASE WHEN {token_chrom('remap1_control')} = {token_chrom('remap2_control')} THEN abs({token_pos('remap2_control')} - {token_pos('remap1_control')}) / 1e6 ELSE control_contact_distances END, 0), 5) AS db FROM p_rows WHERE n1 = n2""")


def _rounded_map(df: DataFrame) -> DataFrame:
    return df.select("ix", "iy", *(F.round(c, 6).alias(c) for c in ("observed", "control", "log2_ratio")))


MAP_SQL["percentile"] = map_sql(hist2d_sql("p_band", "ctrl", "obs", 0, 100, GRID), hist2d_sql(permuted("p_band", "ctrl"), "ctrl", "obs", 0, 100, GRID), GRID)


@query("hist_percentile", MAP_SQL["percentile"])
def hist_percentile(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return _rounded_map(P.percentile_map(c.rows(), c.a.fai, RES, bins=GRID, seed=SEED))


MAP_SQL["distance"] = map_sql(hist2d_sql("p_dist", "db", "da", 0, 5.0, GRID), hist2d_sql(permuted("p_dist", "db"), "db", "da", 0, 5.0, GRID), GRID)


@query("hist_distance", MAP_SQL["distance"])
def hist_distance(spark, sf_dir):
    return _rounded_map(P.distance_map(comparison(spark, sf_dir).lift().rows(columns=P.DISTANCE), bins=GRID, seed=SEED))


def ratio_sql(a: str, b: str) -> str:
    return f"log2((greatest({a} + 1e-6, 0) + 1e-9) / (greatest({b} + 1e-6, 0) + 1e-9))"


MAP_SQL["ratio"] = map_sql(hist2d_sql("p_dist", ratio_sql("da", "db"), ratio_sql("obs", "ctrl"), -12.0, 12.0, GRID), hist2d_sql(permuted("p_dist", "ctrl"), ratio_sql("da", "db"), ratio_sql("obs", "ctrl"), -12.0, 12.0, GRID), GRID)


@query("hist_ratio", MAP_SQL["ratio"])
def hist_ratio(spark, sf_dir):
    return _rounded_map(P.ratio_map(comparison(spark, sf_dir).rows(), bins=GRID, seed=SEED))


def _maps(spark, sf_dir):
    c = comparison(spark, sf_dir)
    return {"percentile": P.percentile_map(c.rows(), c.a.fai, RES, bins=GRID, seed=SEED), "distance": P.distance_map(c.rows(), bins=GRID, seed=SEED), "ratio": P.ratio_map(c.rows(), bins=GRID, seed=SEED)}


@query("map_limits", " UNION ALL ".join(f"SELECT '{name}' AS map, round(greatest(quantile_cont(abs(log2_ratio), 0.99), 1e-6), 4) AS \"limit\" FROM ({sql})" for name, sql in MAP_SQL.items()))
def map_limits(spark, sf_dir):
    return P.map_limits({name: _rounded_map(m) for name, m in _maps(spark, sf_dir).items()}).withColumn("limit", F.round("limit", 4))


SPAN = (-2.0, 2.0)


@query("metric_range", "SELECT round(CASE WHEN lo <> 0 AND hi <> 0 THEN -greatest(abs(lo), abs(hi)) ELSE lo END, 6) AS low, round(CASE WHEN lo <> 0 AND hi <> 0 THEN greatest(abs(lo), abs(hi)) ELSE hi END, 6) AS high FROM (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM p_pbad)")
def metric_range(spark, sf_dir):
    span = P.metric_range(P.metric(comparison(spark, sf_dir).dedup(), RES, frame=FRAME), "pbad") or (None, None)
    return spark.createDataFrame([span], "low double, high double").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("metric_hist", f"SELECT b.bin, round({SPAN[0]} + b.bin * 0.08::DOUBLE, 6) AS low, round({SPAN[0]} + (b.bin + 1) * 0.08::DOUBLE, 6) AS high, round(coalesce(c, 0) / (coalesce(t, 1) * 0.08::DOUBLE), 6) AS density FROM (SELECT CAST(i AS INTEGER) AS bin FROM range(50) t(i)) b LEFT JOIN (SELECT bin, count(*) AS c FROM (SELECT {hist_sql('value', *SPAN, 50)} AS bin FROM p_pbad) WHERE bin IS NOT NULL GROUP BY bin) USING (bin) CROSS JOIN (SELECT count(*) AS t FROM p_pbad WHERE value BETWEEN {SPAN[0]} AND {SPAN[1]})")
def metric_hist(spark, sf_dir):
    h = P.metric_hist(P.metric(comparison(spark, sf_dir).dedup(), RES, frame=FRAME), SPAN)
    return h.select("bin", *(F.round(c, 6).alias(c) for c in ("low", "high", "density")))


@query("metric_kde", f"SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(sum(exp(-((x - value) / 0.1::DOUBLE) * ((x - value) / 0.1::DOUBLE) / 2)) / (count(*) * 0.1::DOUBLE * sqrt(2 * pi())), 6) AS density FROM p_pbad CROSS JOIN (SELECT i, {SPAN[0]} + i * (4.0::DOUBLE / 399) AS x FROM range(400) t(i)) GROUP BY i, x")
def metric_kde(spark, sf_dir):
    k = P.metric_kde(P.metric(comparison(spark, sf_dir).dedup(), RES, frame=FRAME), SPAN)
    return k.select("i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


REGION = ("c0", 0, 1_230_000)
CELL = {"obs": "obs", "ctrl": "ctrl", "diff": "obs - ctrl", "log2ratio": "log2((obs + 1e-6) / (ctrl + 1e-6))"}


def matrix_sql(mode: str) -> str:
    inside = f"chrom1 = 'c0' AND chrom2 = 'c0' AND b1 < {REGION[2] // RES} AND b2 < {REGION[2] // RES}"
    return f"SELECT iy, ix, any_value(round(v, 6)) AS v FROM (SELECT b1 AS iy, b2 AS ix, {CELL[mode]} AS v FROM p_dedup WHERE {inside} UNION ALL SELECT b2, b1, {CELL[mode]} FROM p_dedup WHERE {inside}) GROUP BY iy, ix"


def _matrix(mode: str):
    @query(f"matrix_{mode}", matrix_sql(mode))
    def run(spark, sf_dir):
        return P.region_matrix(comparison(spark, sf_dir).dedup_within(REGION), REGION, REGION, RES, mode).select("iy", "ix", F.round("v", 6).alias("v"))


for m in P.MODES:
    _matrix(m)


@query("matrix_split", f"SELECT coalesce(u.iy, w.iy) AS iy, coalesce(u.ix, w.ix) AS ix, upper, lower FROM (SELECT iy, ix, v AS upper FROM ({matrix_sql('obs')}) WHERE ix >= iy) u FULL JOIN (SELECT iy, ix, v AS lower FROM ({matrix_sql('diff')}) WHERE ix <= iy) w ON u.iy = w.iy AND u.ix = w.ix")
def matrix_split(spark, sf_dir):
    d = comparison(spark, sf_dir).dedup_within(REGION)
    return P.split_matrix(P.region_matrix(d, REGION, REGION, RES, "obs"), P.region_matrix(d, REGION, REGION, RES, "diff"))


@query("color_limit", f"SELECT round(greatest(quantile_cont(abs(v), 0.98), 1e-6), 6) AS \"limit\" FROM ({matrix_sql('diff')})")
def color_limit(spark, sf_dir):
    return P.color_limit(P.region_matrix(comparison(spark, sf_dir).dedup_within(REGION), REGION, REGION, RES, "diff")).select(F.round("limit", 6).alias("limit"))


CUT = 95_000
part("p_sizes", f"SELECT chrom, ord, (size - ord * {CUT}) // {RES} AS n, sum((size - ord * {CUT}) // {RES}) OVER (ORDER BY ord) - (size - ord * {CUT}) // {RES} AS off FROM p_fai_a")


def _cut_fai(spark, sf_dir):
    return A.fai(spark, A.ORDER_A, A.n_bins(spark, sf_dir)).withColumn("size", F.col("size") - F.col("ord") * CUT)


@query("cool_bins", f"SELECT CAST(off + i AS BIGINT) AS bin_id, chrom, i * {RES} AS start, (i + 1) * {RES} AS \"end\" FROM (SELECT *, unnest(range(n)) AS i FROM p_sizes)")
def cool_bins(spark, sf_dir):
    return P.genome_bins(_cut_fai(spark, sf_dir), RES)


def cool_sql(which: str) -> str:
    return f"SELECT CAST(least(x.off + b1, y.off + b2) AS BIGINT) AS bin1_id, CAST(greatest(x.off + b1, y.off + b2) AS BIGINT) AS bin2_id, CAST({which} AS FLOAT) AS count FROM p_dedup JOIN p_sizes x ON chrom1 = x.chrom JOIN p_sizes y ON chrom2 = y.chrom WHERE b1 < x.n AND b2 < y.n"


def _cool(which: str, name: str):
    @query(name, cool_sql(which))
    def run(spark, sf_dir):
        return P.genome_pixels(comparison(spark, sf_dir).dedup(), _cut_fai(spark, sf_dir), RES, which)


_cool("obs", "cool_pixels")
_cool("ctrl", "cool_pixels_control")


@query("bedgraph_track", """SELECT i, coalesce(value, 0.0) AS value FROM (SELECT i FROM range(2500) t(i)) LEFT JOIN (SELECT i - 100 AS i, arg_max(v, p_partkey) AS value FROM (SELECT p_partkey, p_retailprice AS v, unnest(range(greatest(st // 400, 100), least((st + 100 + p_partkey * 131 % 900 + 399) // 400, 2600))) AS i FROM (SELECT *, p_partkey * 7919 % 2000000 AS st FROM part WHERE p_partkey % 4 = 1)) GROUP BY 1) USING (i)""")
def bedgraph_track(spark, sf_dir):
    values = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("line"), F.col("p_retailprice").alias("value"))
    return P.bedgraph_track(A.bed(spark, sf_dir).join(values, "line"), "chrc1", 40_000, 1_040_000, 400)


@query("bed_midpoints", "SELECT x FROM (SELECT (start + \"end\") // 2 AS x FROM p_bed WHERE chrom = 'chrc1') WHERE x >= 100000 AND x < 1500000")
def bed_midpoints(spark, sf_dir):
    return P.midpoints(A.bed(spark, sf_dir), "chrc1", 100_000, 1_500_000)


@query("draw_map", "SELECT b2 - 5 AS x, b1 - 5 AS y, CAST(trunc(least(power(greatest(0.1::DOUBLE * (100 - dev_obs), 2), 2), 100)) AS INTEGER) AS size_obs, obs AS color_obs, CAST(trunc(least(power(greatest(0.1::DOUBLE * (100 - dev_obs - dev_ctrl), 2), 2), 100)) AS INTEGER) AS size_both, obs - ctrl AS color_both FROM p_dedup")
def draw_map(spark, sf_dir):
    return P.draw_map(comparison(spark, sf_dir).dedup(), 200_000, RES)

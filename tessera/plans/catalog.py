"""Queries over the test tables and their DuckDB statements, keyed by name.

The tables stand in for records of the domain: order lines for judged candidates, documents for captions, vector pairs
(2i, 2i+1) for an image and its text, events for detections and logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, jsonx, table_functions, text, vectors
from tessera.operators import batch, ingest, losses, metrics, negatives, packing, regions, retrieval, triplets
from tessera.session import ship
from tessera.sources import headers, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- triplets ------------------------------------------------------------------------------------------------------------

_JUDGED = """
j AS (SELECT l_orderkey AS image, l_partkey AS text, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount AS teacher_score,
             1 - l_tax AS conf, l_linenumber, l_partkey, l_suppkey FROM lineitem),
k AS (SELECT *, sum(label) OVER (PARTITION BY image) AS np, count(*) OVER (PARTITION BY image) AS n FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY CASE WHEN label = 0 THEN -teacher_score END, l_linenumber, l_partkey, l_suppkey, conf, teacher_score) AS r
      FROM k WHERE np > 0 AND np < n),
t AS (SELECT image, text, label, teacher_score, conf,
             CAST(CASE WHEN label = 1 THEN r - 1 ELSE least(np, 2) + r - 1 END AS INTEGER) AS pos
      FROM r WHERE r <= CASE WHEN label = 1 THEN 2 ELSE 4 END)"""


def _mined(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.col("l_partkey").alias("text"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_discount").alias("teacher_score"),
        (1 - F.col("l_tax")).alias("conf"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "conf", "teacher_score")]
    return triplets.mine(rows, order).select("image", "text", "label", "teacher_score", "conf", "pos")


@query(f"WITH {_JUDGED} SELECT image, text, label, teacher_score, conf, pos FROM t")
def triplet_mining(spark, sf):
    return _mined(spark, sf)


@query(
    f"""WITH {_JUDGED}, b AS (SELECT *, image // 64 AS batch, count(*) OVER (PARTITION BY image) AS k FROM t),
    m AS (SELECT *, min(k) OVER (PARTITION BY batch) AS kmin FROM b)
    SELECT batch, image, text, label, teacher_score, conf, pos FROM m WHERE pos < kmin"""
)
def triplet_kmin(spark, sf):
    rows = _mined(spark, sf).withColumn("batch", F.floor(F.col("image") / 64).cast("long"))
    return triplets.truncate_to_batch_minimum(rows, "batch")


@query(
    f"""WITH {_JUDGED} SELECT image, CAST(count(*) AS BIGINT) AS n, CAST(sum(label) AS BIGINT) AS n_positive,
    string_agg(CAST(text AS VARCHAR), '|' ORDER BY pos) AS texts FROM t GROUP BY image"""
)
def triplet_records(spark, sf):
    rec = triplets.nest(_mined(spark, sf))
    return rec.select(
        "image",
        F.size("candidates").cast("long").alias("n"),
        F.size(F.filter("candidates", lambda c: c["label"] == 1)).cast("long").alias("n_positive"),
        F.array_join(F.transform("candidates", lambda c: c["text"].cast("string")), "|").alias("texts"),
    )


# --- captions, dedup, split ------------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, t AS text FROM c WHERE length(t) BETWEEN 5 AND 200""")
def clean_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.clean_text(F.col("text")).alias("text")).filter("text is not null")


@query(r"""SELECT conv_id, turn, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20 AS ok FROM conversations""")
def caption_quality(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.caption_ok(F.col("text")).alias("ok"))


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1")
def exact_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return ingest.exact_dedup(d, F.col("text").cast("binary"), F.col("doc_id")).select("doc_id", "sha1")


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('42|' || doc_id)) AS r, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN r <= greatest(1, n // 100) THEN 'eval' ELSE 'train' END AS split FROM r"""
)
def train_eval_split(spark, sf):
    return ingest.train_eval_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents),
    k AS (SELECT * FROM c WHERE length(t) BETWEEN 5 AND 2000 QUALIFY row_number() OVER (PARTITION BY sha1(t) ORDER BY doc_id) = 1),
    r AS (SELECT *, row_number() OVER (ORDER BY sha1('42|' || doc_id)) AS r, count(*) OVER () AS n FROM k)
    SELECT doc_id, sha1(t) AS sha1, CASE WHEN r <= greatest(1, n // 100) THEN 'eval' ELSE 'train' END AS split FROM r"""
)
def ingest_pipeline(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    rows = d.withColumn("text", text.clean_text(F.col("text"), text.CleanParams(5, 2000))).filter("text is not null")
    return ingest.train_eval_split(ingest.exact_dedup(rows, F.col("text").cast("binary"), F.col("doc_id")).select("doc_id", "sha1"), "doc_id")


@query("SELECT d.doc_id, d.lang, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0")
def label_quality_filter(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(good, "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'N' AS valid FROM lineitem WHERE l_quantity * 300 >= 5120 AND least(l_linenumber * 30, l_quantity * 8) >= 64")
def image_validation(spark, sf):
    li = table(spark, sf, "lineitem")
    ok = tables.valid_image(F.col("l_quantity") * 300, F.col("l_linenumber") * 30, F.col("l_quantity") * 8)
    return li.filter(ok).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "N").alias("valid"))


@query("""SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/data/images/' || p END AS path, lower(regexp_extract(p, '(\\.[^./]+)$', 1)) AS suffix
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/abs/' ELSE '' END || page_id || CASE WHEN page_id % 3 = 0 THEN '.JPG' ELSE '.png' END AS p FROM pages)""".replace("\\\\", "\\"))
def image_paths(spark, sf):
    p = F.concat(F.when(F.col("page_id") % 2 == 0, "/abs/").otherwise(""), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".JPG").otherwise(".png"))
    rows = table(spark, sf, "pages").select("page_id", p.alias("p"))
    return rows.select("page_id", text.resolve_path(F.col("p"), "/data/images").alias("path"), text.suffix(F.col("p")).alias("suffix"))


# --- sizes, tokens, packing --------------------------------------------------------------------------------------------------

_RESIZE = """
s AS (SELECT p_partkey, 28.0 + 37 * p_size AS h, 28.0 + (p_partkey * 131) % 1900 AS w FROM part),
b AS (SELECT *, greatest(28.0, round_even(CAST(h / 28.0 AS DOUBLE), 0) * 28) AS hb, greatest(28.0, round_even(CAST(w / 28.0 AS DOUBLE), 0) * 28) AS wb,
             CAST(h AS DOUBLE) AS hd, CAST(w AS DOUBLE) AS wd FROM s),
z AS (SELECT p_partkey,
   CAST(CASE WHEN hb * wb > 351232 THEN greatest(28, floor(hd / sqrt(hd * wd / 351232) / 28) * 28) WHEN hb * wb < 100352 THEN ceil(hd * sqrt(100352.0::DOUBLE / (hd * wd)) / 28) * 28 ELSE hb END AS INTEGER) AS height,
   CAST(CASE WHEN hb * wb > 351232 THEN greatest(28, floor(wd / sqrt(hd * wd / 351232) / 28) * 28) WHEN hb * wb < 100352 THEN ceil(wd * sqrt(100352.0::DOUBLE / (hd * wd)) / 28) * 28 ELSE wb END AS INTEGER) AS width FROM b)"""


@query(f"WITH {_RESIZE} SELECT p_partkey, height, width, CAST((height // 14) * (width // 14) AS INTEGER) AS tokens FROM z")
def image_tokens(spark, sf):
    h, w = 28 + 37 * F.col("p_size"), 28 + (F.col("p_partkey") * 131) % 1900
    size = geometry.smart_resize(h, w)
    return table(spark, sf, "part").select("p_partkey", size["height"].alias("height"), size["width"].alias("width"), geometry.image_tokens(h, w).alias("tokens"))


@query(
    """WITH s AS (SELECT p_partkey, CAST(28 + 37 * p_size AS DOUBLE) AS h, CAST(28 + (p_partkey * 131) % 1900 AS DOUBLE) AS w FROM part)
    SELECT p_partkey, CAST(CASE WHEN w * h > 175616 THEN greatest(28, floor(h * sqrt(175616.0::DOUBLE / (w * h)))) ELSE h END AS INTEGER) AS height,
           CAST(CASE WHEN w * h > 175616 THEN greatest(28, floor(w * sqrt(175616.0::DOUBLE / (w * h)))) ELSE w END AS INTEGER) AS width FROM s"""
)
def pixel_budget(spark, sf):
    h, w = (28 + 37 * F.col("p_size")).cast("double"), (28 + (F.col("p_partkey") * 131) % 1900).cast("double")
    size = geometry.fit_pixels(h, w, 224 * 28 * 28)
    return table(spark, sf, "part").select("p_partkey", size["height"].alias("height"), size["width"].alias("width"))


BUDGET = 4000
_BINS = """RECURSIVE d AS (SELECT doc_id, source, greatest(1, n_chars // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
b AS (SELECT source, r, doc_id, tokens, 0::BIGINT AS bin_id, tokens AS fill FROM d WHERE r = 1
      UNION ALL
      SELECT d.source, d.r, d.doc_id, d.tokens, CASE WHEN b.fill + d.tokens > 4000 THEN b.bin_id + 1 ELSE b.bin_id END,
             CASE WHEN b.fill + d.tokens > 4000 THEN d.tokens ELSE b.fill + d.tokens END
      FROM b JOIN d ON d.source = b.source AND d.r = b.r + 1)"""


def _packed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens"))
    return packing.build_bins(d, "source", "doc_id", "tokens", BUDGET)


@query(f"WITH {_BINS} SELECT doc_id, source, tokens, bin_id FROM b")
def online_bins(spark, sf):
    return _packed(spark, sf)


@query(
    f"""WITH {_BINS}, p AS (SELECT source, bin_id, count(*) AS c, sum(tokens) AS t FROM b GROUP BY 1, 2)
    SELECT source, CAST(sum(c) AS BIGINT) AS n_items, count(*) AS n_bins, CAST(sum(t) AS BIGINT) AS total, round(sum(t) * 100.0::DOUBLE / (count(*) * 4000), 4) AS fill FROM p GROUP BY source"""
)
def bin_fill(spark, sf):
    return packing.fill_rate(_packed(spark, sf), "tokens", BUDGET, "source")


@query(f"WITH {_BINS} SELECT CAST(bin_id % 4 AS INTEGER) AS rank, count(DISTINCT source || '/' || bin_id) AS n_bins, CAST(sum(tokens) AS BIGINT) AS tokens FROM b GROUP BY 1")
def rank_shards(spark, sf):
    rows = ingest.shards(_packed(spark, sf), "bin_id", 4)
    return rows.groupBy("rank").agg(F.count_distinct(F.concat_ws("/", "source", "bin_id")).alias("n_bins"), F.sum("tokens").alias("tokens"))


def _first_fit(order: str) -> str:
    """First fit decreasing by a recursion: the rooms of a source's bins are a list, each document goes to the first with room."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, n_chars // 4) AS tokens, row_number() OVER (PARTITION BY source ORDER BY greatest(1, n_chars // 4) DESC, {order}) AS r FROM documents),
    b AS (SELECT source, r, doc_id, tokens, 1::BIGINT AS p, [4000 - tokens] AS room FROM d WHERE r = 1
      UNION ALL
      SELECT source, r, doc_id, tokens, p, CASE WHEN p > len(room) THEN list_append(room, 4000 - tokens) ELSE list_transform(room, lambda x, i: CASE WHEN i = p THEN x - tokens ELSE x END) END
      FROM (SELECT d.source, d.r, d.doc_id, d.tokens, b.room, coalesce(list_position(list_transform(b.room, lambda x: x >= d.tokens), true), len(b.room) + 1) AS p FROM b JOIN d ON d.source = b.source AND d.r = b.r + 1))
    SELECT doc_id, source, tokens, p - 1 AS bin_id FROM b"""


@query(_first_fit("doc_id"))
def ffd_bins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens"))
    return packing.first_fit_decreasing(d, "source", "doc_id", "tokens", BUDGET)


@query(_first_fit("sha1('42|' || doc_id)"))
def shuffled_bins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("tokens"))
    return packing.build_bins(d, "source", "doc_id", "tokens", BUDGET, strategy="offline")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM conversations")
def ragged_offsets(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return packing.offsets(c, "conv_id", "turn", "size").drop("size")


@query(
    """WITH p AS (SELECT conv_id, turn, length(text) AS s, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS BIGINT) AS chunk FROM conversations)
    SELECT conv_id, turn, chunk, CAST(coalesce(sum(s) OVER (PARTITION BY conv_id, chunk ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p"""
)
def packed_chunks(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return packing.chunks(c, "conv_id", "turn", "size", 2).drop("size")


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, source, CAST(i // 16 AS BIGINT) AS batch, CAST(i % 16 AS INTEGER) AS pos FROM r WHERE i // 16 < n // 16"""
)
def fixed_batches(spark, sf):
    return ingest.batches(table(spark, sf, "documents").select("doc_id", "source"), F.col("doc_id"), 16, True, ("source",))


# --- vectors -------------------------------------------------------------------------------------------------------------------

#: Ids of one evaluation batch, as the losses are defined on batches; every batch is read.
EVAL_BATCH = 200
_SIDES = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
u AS (SELECT vec_id // 2 AS i, v FROM e WHERE vec_id % 2 = 0), t AS (SELECT vec_id // 2 AS j, v FROM e WHERE vec_id % 2 = 1),
n AS (SELECT i FROM u WHERE i IN (SELECT j FROM t))"""
_PAIRS = f"""{_SIDES},
sims AS (SELECT u.i, t.j, list_sum(list_transform(range(1, 65), lambda k: u.v[k] * t.v[k])) AS s FROM u, t WHERE u.i IN (SELECT i FROM n) AND t.j IN (SELECT i FROM n))"""
_BATCHES = f"""{_SIDES},
sims AS (SELECT u.i, t.j, list_sum(list_transform(range(1, 65), lambda k: u.v[k] * t.v[k])) AS s FROM u JOIN t ON u.i // {EVAL_BATCH} = t.j // {EVAL_BATCH} WHERE u.i IN (SELECT i FROM n) AND t.j IN (SELECT i FROM n))"""


def _pairs(spark, sf):
    """The two sides of every pair of the table: (i, u) and (j, v)."""
    e = table(spark, sf, "embeddings")
    half = lambda r, name, v: e.filter(F.col("vec_id") % 2 == r).select(F.floor(F.col("vec_id") / 2).cast("long").alias(name), F.col("embedding").alias(v))
    return half(0, "i", "u"), half(1, "j", "v")


def _batch_sims(spark, sf):
    """The similarities within every batch of EVAL_BATCH ids; an id is of one batch, so sums by row or column are too."""
    left, right = _pairs(spark, sf)
    both = left.join(right, F.col("i") == F.col("j")).select("i", "u", "v", F.floor(F.col("i") / EVAL_BATCH).alias("batch"))
    return retrieval.similarities(both.select("batch", "i", "u"), both.select("batch", F.col("i").alias("j"), "v"), "batch")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    m AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(range(1, 65), lambda k: q.v[k] * c.v[k])), 12) AS score FROM m q, m c WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def topk_search(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    got = retrieval.top_k(e.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), e, 5)
    return got.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query()
def ann_search(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    centres = retrieval.train_cells(e, 16)
    return retrieval.ann_top_k(e.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), e, 5, centres, 12)


def _recall_sql() -> str:
    ks = ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS r{k}" for k in (1, 5, 10))
    sides = " UNION ALL ".join(f"SELECT '{n}_R@{k}' AS metric, r{k} AS value FROM {n}" for n in ("i2t", "t2i") for k in (1, 5, 10))
    return f"""WITH {_PAIRS}, g AS (SELECT i AS g, s AS gs FROM sims WHERE i = j),
    ri AS (SELECT i, 1 + sum(CASE WHEN s > gs OR (s = gs AND j < i) THEN 1 ELSE 0 END) AS r FROM sims JOIN g ON i = g GROUP BY i),
    rj AS (SELECT j, 1 + sum(CASE WHEN s > gs OR (s = gs AND i < j) THEN 1 ELSE 0 END) AS r FROM sims JOIN g ON j = g GROUP BY j),
    i2t AS (SELECT {ks} FROM ri), t2i AS (SELECT {ks} FROM rj) {sides} UNION ALL SELECT 'hit@5', r5 FROM i2t"""


@query(_recall_sql())
def recall_at_k(spark, sf):
    return retrieval.recall_at_k(*_pairs(spark, sf))


@query(
    f"""WITH {_BATCHES}, x AS (SELECT i, j, s * 20 AS x FROM sims),
    ri AS (SELECT i, ln(sum(exp(x))) AS l FROM x GROUP BY i), rj AS (SELECT j, ln(sum(exp(x))) AS l FROM x GROUP BY j),
    c AS (SELECT ri.l - x.x AS ce FROM x JOIN ri ON x.i = ri.i WHERE x.i = x.j UNION ALL SELECT rj.l - x.x FROM x JOIN rj ON x.j = rj.j WHERE x.i = x.j)
    SELECT round(avg(ce), 6) AS loss FROM c"""
)
def info_nce_loss(spark, sf):
    return losses.info_nce(_batch_sims(spark, sf), 20.0).select(F.round("loss", 6).alias("loss"))


@query(
    f"""WITH {_BATCHES}, x AS (SELECT i, (CASE WHEN i = j THEN 1 ELSE -1 END) * (10 * s - 10) AS x, i = j AS d FROM sims)
    SELECT round(sum(greatest(-x, 0) + ln(1 + exp(-abs(x)))) / count(*) FILTER (WHERE d), 6) AS loss FROM x"""
)
def sigmoid_loss(spark, sf):
    import math

    return losses.pairwise_sigmoid(_batch_sims(spark, sf), math.log(10.0), -10.0).select(F.round("loss", 6).alias("loss"))


def _all_pairs(spark, sf):
    return retrieval.complete_pairs(*_pairs(spark, sf))


@query(
    f"""WITH {_PAIRS}, x AS (SELECT i, j, s * 100 AS x FROM sims), mi AS (SELECT i, max(x) AS m FROM x GROUP BY i), mj AS (SELECT j, max(x) AS m FROM x GROUP BY j),
    ri AS (SELECT x.i, any_value(m) + ln(sum(exp(x - m))) AS l FROM x JOIN mi ON x.i = mi.i GROUP BY x.i), rj AS (SELECT x.j, any_value(m) + ln(sum(exp(x - m))) AS l FROM x JOIN mj ON x.j = mj.j GROUP BY x.j)
    SELECT round(avg((ri.l + rj.l) / 2 - x.x), 6) AS loss FROM x JOIN ri ON x.i = ri.i JOIN rj ON x.j = rj.j WHERE x.i = x.j"""
)
def info_nce_one_batch(spark, sf):
    """All pairs of the table are one batch."""
    return losses.batch_info_nce(_all_pairs(spark, sf), 100.0).select(F.round("loss", 6).alias("loss"))


_SOFTPLUS = "greatest(-x, 0) + ln(1 + exp(-abs(x)))"


@query(f"WITH {_PAIRS}, x AS (SELECT i, (CASE WHEN i = j THEN 1 ELSE -1 END) * (10 * s - 10) AS x FROM sims) SELECT round(sum({_SOFTPLUS}) / count(DISTINCT i), 6) AS loss FROM x")
def sigmoid_one_batch(spark, sf):
    import math

    return losses.batch_sigmoid(_all_pairs(spark, sf), math.log(10.0), -10.0).select(F.round("loss", 6).alias("loss"))


@query(
    f"""WITH {_PAIRS}, x AS (SELECT i, j, (CASE WHEN i = j THEN 1 ELSE -1 END) * (10 * s - 10) AS x FROM sims),
    one AS (SELECT i, {_SOFTPLUS} AS l FROM x WHERE j % 5 <> 0 UNION ALL SELECT j, {_SOFTPLUS} FROM x WHERE i % 5 <> 0),
    r AS (SELECT least(i % 7, 3) AS rank, count(DISTINCT i) AS n, sum(l) / 2 / count(DISTINCT i) AS loss FROM one GROUP BY 1)
    SELECT CAST(rank AS BIGINT) AS rank, n, max(n) OVER () - n AS padding, round(loss, 6) AS loss FROM r"""
)
def sigmoid_by_rank(spark, sf):
    """Ranks of unequal numbers of rows share one batch; keys with an id divisible by 5 are not valid."""
    import math

    rows = _all_pairs(spark, sf).withColumn("rank", F.least(F.col("i") % 7, F.lit(3)))
    got = losses.batch_sigmoid(rows, math.log(10.0), -10.0, "rank", F.col("i") % 5 != 0)
    return got.select("rank", "n", "padding", F.round("loss", 6).alias("loss"))


@query(
    f"""WITH {_SIDES}, z AS (SELECT u.i, t.j, round(list_sum(list_transform(range(1, 65), lambda k: u.v[k] * t.v[k]))
        / sqrt(list_sum(list_transform(u.v, lambda x: x * x)) * list_sum(list_transform(t.v, lambda x: x * x))), 12) AS s FROM u, t),
    r AS (SELECT 'i2t' AS side, i AS query_id, j AS vec_id, s, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r FROM z
          UNION ALL SELECT 't2i', j, i, s, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) FROM z)
    SELECT side, query_id, vec_id, CAST(r AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE r <= 3"""
)
def topk_both_ways(spark, sf):
    return retrieval.top_k_both_ways(*_pairs(spark, sf), 3).select("side", "query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_JUDGED}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
    SELECT t.image, t.text, t.pos, t.label, round(list_sum(list_transform(range(1, 65), lambda k: a.v[k] * b.v[k]))
        / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))), 6) AS s
    FROM t JOIN e a ON a.vec_id = t.image JOIN e b ON b.vec_id = t.text"""
)
def candidate_similarities(spark, sf):
    e = table(spark, sf, "embeddings")
    cands = _mined(spark, sf).withColumn("anchor", F.col("image"))
    vec = lambda name: e.select(F.col("vec_id").alias(name), F.col("embedding").alias("v"))
    got = retrieval.candidate_similarities(vec("anchor"), cands, vec("text"))
    return got.select("image", "text", "pos", "label", F.round("s", 6).alias("s"))


_CANDS = """c AS (SELECT l_orderkey AS anchor, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, (l_extendedprice / 100000.0::DOUBLE) AS s, l_discount * 10 AS teacher_score, l_tax * 10 AS w FROM lineitem)"""


def _cands(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("anchor"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_extendedprice") / 100000.0).alias("s"),
        (F.col("l_discount") * 10).alias("teacher_score"),
        (F.col("l_tax") * 10).alias("w"),
    )


_TRIPLET = "p AS (SELECT anchor, avg(s) FILTER (WHERE label = 1) AS p, max(s) FILTER (WHERE label = 0) AS n FROM c GROUP BY anchor), lt AS (SELECT coalesce(avg(greatest(0.2::DOUBLE + n - p, 0)) FILTER (WHERE p IS NOT NULL AND n IS NOT NULL), 0) AS l FROM p)"
_DISTILL = "ld AS (SELECT sum(w * pow(1 / (1 + exp(-(5 * s - 1))) - teacher_score, 2)) / greatest(sum(w), 1e-6) AS l FROM c)"


@query(f"WITH {_CANDS}, {_TRIPLET} SELECT round(l, 6) AS loss FROM lt")
def triplet_margin_loss(spark, sf):
    return losses.triplet_loss(_cands(spark, sf)).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_CANDS}, {_DISTILL} SELECT round(l, 6) AS loss FROM ld")
def distillation_loss(spark, sf):
    return losses.distillation_loss(_cands(spark, sf), weight=F.col("w")).select(F.round("loss", 6).alias("loss"))


@query(f"WITH {_CANDS}, {_TRIPLET}, {_DISTILL} SELECT round(lt.l, 6) AS l_triplet, round(ld.l, 6) AS l_distill, round(lt.l + 0.5 * ld.l, 6) AS loss FROM lt, ld")
def combined_loss(spark, sf):
    c = _cands(spark, sf)
    got = losses.combined_loss(losses.triplet_loss(c), losses.distillation_loss(c, weight=F.col("w")))
    return got.select(*[F.round(x, 6).alias(x) for x in ("l_triplet", "l_distill", "loss")])


@query(
    """WITH c AS (SELECT l_orderkey AS region, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_extendedprice / 100000.0::DOUBLE * 10 AS x FROM lineitem),
    m AS (SELECT *, max(x) OVER (PARTITION BY region) AS m FROM c), r AS (SELECT region, max(m) + ln(sum(exp(x - m))) - max(x) FILTER (WHERE pos = 0) AS ce FROM m GROUP BY region)
    SELECT round(avg(ce), 6) AS loss FROM r"""
)
def many_way_loss(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("region"), (F.row_number().over(w) - 1).alias("pos"), (F.col("l_extendedprice") / 100000.0).alias("s"))
    return losses.many_way_loss(c, 10.0).select(F.round("loss", 6).alias("loss"))


@query("SELECT label, CAST(d - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[d] AS DOUBLE)), 6) AS value FROM embeddings, range(1, 65) t(d) GROUP BY 1, 2")
def mean_pool(spark, sf):
    got = regions.mean_pool(table(spark, sf, "embeddings"), "label", "embedding")
    return got.select("label", "dim", F.round("value", 6).alias("value"))


# --- regions ---------------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM events WHERE value > 0.1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def best_box(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return regions.best_boxes(e, "user_id", "event_type", "value", "event_id")


_BOX = "x AS (SELECT p_partkey, (p_partkey % 10) / 10.0::DOUBLE AS x1, (p_size % 8) / 8.0::DOUBLE AS y1, least(1, (p_partkey % 10) / 10.0::DOUBLE + p_size / 50.0::DOUBLE) AS x2, least(1, (p_size % 8) / 8.0::DOUBLE + 0.25) AS y2 FROM part)"


def _boxes(spark, sf):
    x1, y1 = (F.col("p_partkey") % 10) / 10.0, (F.col("p_size") % 8) / 8.0
    return table(spark, sf, "part").select("p_partkey", x1.alias("x1"), y1.alias("y1"), F.least(F.lit(1.0), x1 + F.col("p_size") / 50.0).alias("x2"), F.least(F.lit(1.0), y1 + 0.25).alias("y2"))


@query(
    f"""WITH {_BOX}, a AS (SELECT *, CAST(least(greatest(floor(x1 * 16), 0), 15) AS INTEGER) AS c1, CAST(least(greatest(floor(y1 * 12), 0), 11) AS INTEGER) AS r1 FROM x)
    SELECT p_partkey, c1, CAST(greatest(c1 + 1, least(floor(x2 * 16) + 1, 16)) AS INTEGER) AS c2, r1, CAST(greatest(r1 + 1, least(floor(y2 * 12) + 1, 12)) AS INTEGER) AS r2 FROM a"""
)
def bbox_cells(spark, sf):
    cells = geometry.box_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(16), F.lit(12))
    return _boxes(spark, sf).select("p_partkey", cells.alias("c")).select("p_partkey", "c.*")


@query(f"WITH {_BOX} SELECT p_partkey, CAST(floor(x1 * 640) AS INTEGER) AS px1, CAST(floor(y1 * 480) AS INTEGER) AS py1, CAST(floor(x2 * 640) AS INTEGER) AS px2, CAST(floor(y2 * 480) AS INTEGER) AS py2 FROM x")
def pixel_boxes(spark, sf):
    box = geometry.pixel_box(F.array("x1", "y1", "x2", "y2"), F.lit(640), F.lit(480))
    return _boxes(spark, sf).select("p_partkey", box.alias("b")).select("p_partkey", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("px1", "py1", "px2", "py2"))])


@query(
    """SELECT o.o_orderkey AS image, l.l_partkey AS reason_id, CASE WHEN l.l_returnflag = 'R' THEN l.l_linestatus ELSE '' END AS reason_text,
    CASE WHEN l.l_returnflag = 'R' THEN 'relevant' ELSE 'irrelevant' END AS prior FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey"""
)
def candidate_explode(spark, sf):
    li = table(spark, sf, "lineitem")
    rel = F.col("l_returnflag") == "R"
    entry = F.struct(F.col("l_partkey").alias("reason_id"), F.when(rel, F.col("l_linestatus")).otherwise("").alias("reason_text"), F.when(rel, "relevant").otherwise("irrelevant").alias("prior"))
    nested = li.groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_list(entry).alias("candidates"))
    return regions.explode_candidates(nested.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("image")), "image"))


@query(
    """WITH r AS (SELECT l_orderkey AS image, l_partkey AS expr, min(l_quantity) AS conf FROM lineitem GROUP BY 1, 2),
    n AS (SELECT l_orderkey AS image, l_partkey AS expr, arg_max(l_suppkey, l_suppkey) AS hard FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT r.image, CAST(r.expr AS VARCHAR) AS expr, r.conf, CAST(n.hard AS VARCHAR) AS hard FROM r JOIN n USING (image, expr)"""
)
def region_assemble(spark, sf):
    li = table(spark, sf, "lineitem")
    flat = li.groupBy(F.col("l_orderkey").alias("image"), F.col("l_partkey").cast("string").alias("expr")).agg(F.min("l_quantity").alias("conf"))
    nested = flat.groupBy("image").agg(F.collect_list(F.struct("expr", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), "conf")).alias("regions")).withColumn("caption", F.lit(""))
    neg = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image"), F.col("l_partkey").cast("string").alias("expr"), F.array(F.col("l_suppkey").cast("string")).alias("hard"), F.col("l_suppkey").alias("ord"))
    return regions.assemble(nested, neg).select("image", F.inline("regions")).select("image", "expr", "conf", F.get("hard", F.lit(0)).alias("hard"))


# --- generated text --------------------------------------------------------------------------------------------------------------

_RULE_ORDER = "SELECT p_partkey, p_name, w, o, row_number() OVER (PARTITION BY p_partkey, strat ORDER BY sha1('42|' || p_name || '|' || o)) AS k, strat FROM h, unnest(list_filter(grp, lambda x: x <> w)) AS u(o)"


@query(
    f"""WITH g(strat, grp) AS (VALUES (1, ['red', 'blue', 'green', 'black', 'white']), (2, ['small', 'large'])),
    a AS (SELECT p_partkey, p_name, strat, grp, u.w, instr(p_name, u.w) AS pos FROM part, g, unnest(grp) AS u(w)),
    h AS (SELECT p_partkey, p_name, strat, grp, w, pos FROM a WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey, strat ORDER BY pos, list_position(grp, w)) = 1),
    c AS ({_RULE_ORDER}), m AS (SELECT c.p_partkey, c.strat, c.k, substr(c.p_name, 1, h.pos - 1) || c.o || substr(c.p_name, h.pos + length(c.w)) AS neg FROM c JOIN h ON c.p_partkey = h.p_partkey AND c.strat = h.strat WHERE c.k <= 2)
    SELECT p_partkey, neg FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY strat, k) <= 2"""
)
def rule_negatives(spark, sf):
    made = F.slice(negatives.rule_negatives(F.col("p_name"), text.RULES_ENGLISH), 1, 2)
    return table(spark, sf, "part").select("p_partkey", F.explode(made).alias("neg"))


#: The longest common part of two strings: its length k and where it begins, earliest in a, then in b.
_LONGEST = """list_transform([list_transform(range(1, len(a) + 1), lambda i: list_max(list_filter(range(0, len(a) - i + 2), lambda k: contains(b, substr(a, i, k)))))],
    lambda ks: {'k': list_max(ks), 'i': list_position(ks, list_max(ks)), 'j': instr(b, substr(a, list_position(ks, list_max(ks)), list_max(ks)))})[1]"""


def _ratios(pairs: str) -> str:
    """CTEs that end in ``ratios`` (a, b, ratio) of the distinct pairs: the longest common part, then what lies left and right of it."""
    return f"""_pairs AS (SELECT DISTINCT a, b FROM ({pairs})),
    _parts AS (SELECT a AS wa, b AS wb, a, b, {_LONGEST} AS m FROM _pairs WHERE a <> '' AND b <> ''
      UNION ALL
      SELECT wa, wb, a, b, {_LONGEST} AS m FROM (
        SELECT wa, wb, CASE WHEN side = 1 THEN substr(a, 1, m.i - 1) ELSE substr(a, m.i + m.k) END AS a, CASE WHEN side = 1 THEN substr(b, 1, m.j - 1) ELSE substr(b, m.j + m.k) END AS b
        FROM _parts, range(1, 3) t(side) WHERE m.k > 0) WHERE a <> '' AND b <> ''),
    ratios AS (SELECT a, b, coalesce(2.0::DOUBLE * (SELECT sum(m.k) FROM _parts p WHERE p.wa = q.a AND p.wb = q.b) / nullif(len(a) + len(b), 0), 1.0) AS ratio FROM _pairs q)"""


_RULES = f"""g(strat, grp) AS (VALUES (1, ['red', 'blue', 'green', 'black', 'white']), (2, ['small', 'large'])),
    a AS (SELECT p_partkey, p_name, strat, grp, u.w, instr(p_name, u.w) AS pos FROM part, g, unnest(grp) AS u(w)),
    h AS (SELECT p_partkey, p_name, strat, grp, w, pos FROM a WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey, strat ORDER BY pos, list_position(grp, w)) = 1),
    c AS ({_RULE_ORDER}),
    made AS (SELECT c.p_partkey, c.p_name, c.strat, c.k, substr(c.p_name, 1, h.pos - 1) || c.o || substr(c.p_name, h.pos + length(c.w)) AS neg FROM c JOIN h ON c.p_partkey = h.p_partkey AND c.strat = h.strat WHERE c.k <= 2)"""
_PLAUSIBLE = "length(neg) > 0 AND neg <> p_name AND length(neg) BETWEEN 0.4 * length(p_name) AND 2.5 * length(p_name)"


@query(
    f"""WITH RECURSIVE {_RULES}, p AS (SELECT p_partkey, p_name, neg FROM made WHERE {_PLAUSIBLE}), {_ratios("SELECT p_name AS a, neg AS b FROM p")}
    SELECT p_partkey, p_name AS expr, neg, round(ratio, 6) AS ratio FROM p JOIN ratios ON a = p_name AND b = neg WHERE ratio >= 0.5"""
)
def valid_negative(spark, sf):
    made = negatives.rule_negatives(F.col("p_name"), text.RULES_ENGLISH)
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("expr"), F.explode(made).alias("neg"))
    return negatives.valid_negatives(rows).withColumn("ratio", F.round("ratio", 6))


@query(
    f"""WITH RECURSIVE n AS (SELECT p.p_partkey, p.p_name, 'next' AS other, q.p_name AS neg FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 UNION ALL SELECT p_partkey, p_name, 'type', p_type FROM part),
    {_ratios("SELECT p_name AS a, neg AS b FROM n")} SELECT p_partkey, other, round(ratio, 6) AS ratio FROM n JOIN ratios ON a = p_name AND b = neg"""
)
def sequence_ratios(spark, sf):
    """Every name against the next part's name and against its own type."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("neg"))
    rows = part.join(following, "p_partkey").select("p_partkey", "p_name", F.lit("next").alias("other"), "neg").unionByName(part.select("p_partkey", "p_name", F.lit("type").alias("other"), F.col("p_type").alias("neg")))
    return rows.select("p_partkey", "other", F.round(negatives.sequence_ratio("p_name", "neg"), 6).alias("ratio"))


_EDGE = r"""regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[0-9.、\-·* \t"''“”‘’]+|[0-9.、\-·* \t"''“”‘’]+$', '', 'g')"""


@query(
    f"""WITH RECURSIVE {_RULES}, s AS (SELECT p_partkey, p_name, u.i, {_EDGE} AS neg FROM (SELECT p_partkey, p_name, ['1. ' || regexp_replace(p_name, 'red|small', 'pale', 'g'), '- ' || p_type] AS lines FROM part), unnest(lines) WITH ORDINALITY AS u(line, i)),
    p AS (SELECT p_partkey, p_name, min(i) AS i, neg FROM s WHERE {_PLAUSIBLE} GROUP BY p_partkey, p_name, neg), {_ratios("SELECT p_name AS a, neg AS b FROM p")},
    ours AS (SELECT p_partkey, p_name, neg, 0 AS strat, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM p JOIN ratios ON a = p_name AND b = neg WHERE ratio >= 0.5),
    every AS (SELECT p_partkey, p_name, neg, strat, k FROM ours WHERE k <= 2 UNION ALL SELECT p_partkey, p_name, neg, strat, k FROM made WHERE neg <> p_name),
    firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY p_partkey, neg ORDER BY strat, k) = 1),
    used AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY strat, k) <= 2)
    SELECT p_partkey AS image, p_name AS expr, string_agg(neg, '|' ORDER BY strat, k) AS hard FROM used GROUP BY 1, 2"""
)
def hard_negatives(spark, sf):
    raw = F.concat(F.lit("1. "), F.regexp_replace("p_name", "red|small", "pale"), F.lit("\n- "), F.col("p_type"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.col("p_name").alias("expr"), raw.alias("raw"))
    return negatives.hard_negatives(rows, rules=text.RULES_ENGLISH).select("image", "expr", F.array_join("hard", "|").alias("hard"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '[\n\r\x0B\f]')) AS line FROM documents)
    SELECT doc_id, count(*) AS n, sum(length(t)) :: BIGINT AS chars FROM (SELECT doc_id, regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[0-9.、\-·* \t"''“”‘’]+|[0-9.、\-·* \t"''“”‘’]+$', '', 'g') AS t FROM l) WHERE t <> '' GROUP BY doc_id"""
)
def parse_lines(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(text.parse_lines(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("t")).cast("long").alias("chars"))


@query("SELECT p_partkey, length(p_brand) >= 2 AND contains(p_name || ' ' || p_brand, p_brand) AND NOT regexp_matches(p_brand, '^(它|他|她|这个|那个|这些|那些|其|该)') AS ok FROM part")
def valid_expression(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.valid_expression(F.col("p_brand"), F.concat_ws(" ", "p_name", "p_brand")).alias("ok"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def extract_json(spark, sf):
    third = F.col("event_id") % 3
    raw = F.when(third == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(third == 1, F.col("props")).otherwise(F.concat("props", F.lit(" y "), "props"))
    rows = table(spark, sf, "events").select("event_id", jsonx.extract_json(raw).alias("j"))
    return rows.select("event_id", F.from_json("j", "k int")["k"].alias("k"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 2 = 0 THEN '相关' ELSE '不相关' END AS label,
    CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 2 = 0 THEN round((event_id % 100) / 100.0::DOUBLE, 4) ELSE round(1 - (event_id % 100) / 100.0::DOUBLE, 4) END AS teacher_score,
    CASE WHEN event_id % 4 = 3 THEN 'analysis' END AS reason FROM events"""
)
def judge_parse(spark, sf):
    label = F.when(F.col("event_id") % 2 == 0, "相关").otherwise("不相关")
    analysis = F.when(F.col("event_id") % 4 == 3, "short").otherwise("the picture shows what the rule names")
    raw = F.concat(F.lit('ok {"label": "'), label, F.lit('", "analysis": "'), analysis, F.lit('", "confidence": '), ((F.col("event_id") % 100) / 100.0).cast("string"), F.lit("} done"))
    rows = table(spark, sf, "events").select("event_id", jsonx.extract_json(raw).alias("j"))
    return rows.select("event_id", jsonx.parse_judgement(F.col("j")).alias("p")).select("event_id", "p.label", "p.teacher_score", "p.reason")


@query("SELECT DISTINCT user_id, event_type, sha1(user_id || '|judge|v1|' || event_type) AS key FROM events")
def cache_key(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type").distinct()
    return e.select("user_id", "event_type", text.make_key(F.col("user_id").cast("string"), "judge", "v1", F.col("event_type")).alias("key"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS image, event_type AS reason_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 2 = 0 AND d.user_id = e.user_id AND d.event_type = e.event_type)")
def pending(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("image"), F.col("event_type").alias("reason_id"), "event_id")
    task = batch.TASKS["judge"]
    done = batch.keyed(e.filter("event_id % 2 = 0"), task)
    return batch.pending(e.drop("event_id"), done, task).select("image", "reason_id")


@query("SELECT status, count(*) AS n FROM (SELECT DISTINCT user_id, CASE WHEN length('Describe the image in detail. [' || user_id || ']') >= 20 THEN 'ok' ELSE 'failed' END AS status FROM events) GROUP BY status")
def batch_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("image"))
    task = batch.TASKS["caption"]
    ok, bad = batch.split_results(batch.infer(batch.pending(e, None, task), task, batch.BACKENDS["echo"]()), task)
    rows = ok.select(F.lit("ok").alias("status")).unionByName(bad.select(F.lit("failed").alias("status")))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS image, event_type AS reason_id, 'no json' AS reason, 'Rule ' || event_type || ' : does the image break it? Answer as JSON. [' || user_id || ']' AS raw_output FROM events")
def failures(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("image"), F.col("event_type").alias("reason_id"))
    task = batch.TASKS["judge"]
    _, bad = batch.split_results(batch.infer(batch.pending(e, None, task), task, batch.BACKENDS["echo"]()), task)
    return bad.select("record.image", "record.reason_id", "reason", "raw_output")


# --- logs --------------------------------------------------------------------------------------------------------------------------

_LOG = "l AS (SELECT event_id, event_id // 3 AS step, value FROM events WHERE event_type <> 'error')"


@query(f"WITH {_LOG} SELECT CAST(step AS INTEGER) AS step, value AS loss FROM l QUALIFY row_number() OVER (PARTITION BY step ORDER BY event_id DESC) = 1")
def metric_curve(spark, sf):
    nothing = F.lit(None).cast("double")
    log = table(spark, sf, "events").filter("event_type <> 'error'")
    log = log.select("event_id", F.floor(F.col("event_id") / 3).cast("int").alias("step"), F.col("value").alias("loss"), *[nothing.alias(c) for c in ("lr", "tau", "bias", "grad_norm", "samples_per_s")])
    return metrics.training_curve(log, "event_id").select("step", "loss")


@query("SELECT CAST(ceil((event_id + 1) / 50.0) * 50 AS BIGINT) AS log_step, round(avg(value), 6) AS value FROM events GROUP BY 1")
def running_mean(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") + 1).alias("step"), "value")
    return metrics.running_mean(e, "value", 50)


@query("SELECT round(avg(m), 6) AS value FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)")
def mean_of_means(spark, sf):
    return metrics.mean_of_means(table(spark, sf, "events"), "event_type", "value").select(F.round("value", 6).alias("value"))


@query("SELECT event_type, count(*) AS n, max(count(*)) OVER () - count(*) AS padding FROM events GROUP BY 1")
def counts_by_rank(spark, sf):
    return metrics.counts_by_rank(table(spark, sf, "events"), "event_type")


@query("SELECT event_id, round(CASE WHEN event_id < 200 THEN (event_id + 1) / 200.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1, (event_id - 200) / 4800.0::DOUBLE))) END, 6) AS factor FROM events")
def lr_schedule(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(vectors.cosine_warmup(F.col("event_id"), 200, 5000), 6).alias("factor"))


@query("SELECT 'ckpt_step' || event_id || '.pt' AS name, CAST(event_id AS INTEGER) AS step FROM events ORDER BY event_id DESC LIMIT 3")
def checkpoint_retention(spark, sf):
    names = table(spark, sf, "events").select(F.concat(F.lit("ckpt_step"), F.col("event_id").cast("string"), F.lit(".pt")).alias("name"))
    return ingest.newest_checkpoints(names, 3)


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS images, round(count(*) / count(DISTINCT l_orderkey), 4) AS per_item, round(min(l_quantity), 4) AS least, round(max(l_quantity), 4) AS most, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1")
def region_statistics(spark, sf):
    got = regions.count_report(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", ("l_returnflag",))
    return got.select("l_returnflag", "n", F.col("items").alias("images"), "per_item", *[F.round(c, 4).alias(c) for c in ("least", "most", "mean")])


@query(
    f"""WITH {_BOX}, a AS (SELECT *, p_partkey % 5 AS image, CAST(least(greatest(floor(x1 * 16), 0), 15) AS INTEGER) AS c1, CAST(least(greatest(floor(y1 * 12), 0), 11) AS INTEGER) AS r1 FROM x),
    b AS (SELECT image, p_partkey AS box_id, c1, greatest(c1 + 1, least(floor(x2 * 16) + 1, 16)) AS c2, r1, greatest(r1 + 1, least(floor(y2 * 12) + 1, 12)) AS r2 FROM a),
    g AS (SELECT r_regionkey AS image, i % 16 AS col, i // 16 AS row, (i * 7 + r_regionkey) % 100 AS value FROM region, range(192) t(i))
    SELECT box_id, count(*) AS n, round(avg(value), 6) AS value FROM b JOIN g USING (image) WHERE col >= c1 AND col < c2 AND row >= r1 AND row < r2 GROUP BY box_id"""
)
def region_pool(spark, sf):
    cells = geometry.box_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(16), F.lit(12))
    boxes = _boxes(spark, sf).select((F.col("p_partkey") % 5).alias("image"), F.col("p_partkey").alias("box_id"), cells.alias("c")).select("image", "box_id", "c.*")
    grid = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(191))).alias("i"))
    grid = grid.select("image", (F.col("i") % 16).alias("col"), F.floor(F.col("i") / 16).alias("row"), ((F.col("i") * 7 + F.col("image")) % 100).alias("value"))
    return regions.box_pool(grid, boxes).select("box_id", "n", F.round("value", 6).alias("value"))


@query("SELECT event_id, CAST(i // 8 * 2 + (i % 8 % 4) // 2 AS INTEGER) AS row, CAST((i % 8) // 4 * 2 + i % 2 AS INTEGER) AS col FROM (SELECT event_id, event_id % 64 AS i FROM events)")
def patch_cells(spark, sf):
    cell = geometry.patch_cell(F.col("event_id") % 64, F.lit(4))
    return table(spark, sf, "events").select("event_id", cell["row"].alias("row"), cell["col"].alias("col"))


@query(
    """WITH r AS (SELECT l_orderkey AS image, l_partkey, l_suppkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) - 1 AS region FROM lineitem)
    SELECT image, CAST(region AS INTEGER) AS region, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'part ' || l_partkey WHEN 1 THEN 'supplier ' || l_suppkey ELSE 'line ' || l_linenumber END AS text, 3 AS n FROM r, range(3) t(pos) WHERE region < 4"""
)
def region_candidates(spark, sf):
    said = lambda word, col: F.concat(F.lit(word + " "), F.col(col).cast("string"))
    entry = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.struct(said("part", "l_partkey").alias("expr"), F.array(said("supplier", "l_suppkey"), said("line", "l_linenumber")).alias("hard")).alias("r"))
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
    return regions.candidates_of_regions(nested.select("image", F.transform("c", lambda c: c["r"]).alias("regions")))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def image_join(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("/data/"), F.col("o_custkey").cast("string")).alias("image"))
    images = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"), "c_name")
    found, _ = regions.join_images(rows, images)
    return found.select("o_orderkey", "c_name")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def first_rows(spark, sf):
    return ingest.take_first(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 20)


@query("SELECT event_id, round(value + 0.1 * (value * 2) + 0.5 * (value * 3), 6) AS loss FROM events")
def total_region_loss(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(losses.total_region_loss(v, v * 2, v * 3), 6).alias("loss"))


@query("SELECT conv_id, turn, sha1(text) AS sha1 FROM conversations WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) >= 20")
def caption_parse(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", jsonx.parse_caption(F.col("text")).alias("p"))
    return rows.filter("p.reason is null").select("conv_id", "turn", F.sha1(F.col("text").cast("binary")).alias("sha1"))


# --- resumption, grounding, statistics, collation --------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def resume_images(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("image"), "event_type", "value")
    return regions.resume_images(e, e.filter("event_type = 'error' and value > 100")).select("event_id")


@query(
    """SELECT DISTINCT l_orderkey AS image, CAST(l_partkey AS VARCHAR) AS expr FROM lineitem
    WHERE (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')"""
)
def resume_expressions(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_partkey").cast("string").alias("expr"), "l_returnflag")
    nested = li.groupBy("image").agg(F.collect_list(F.struct("expr")).alias("regions"))
    return regions.resume_expressions(nested, li.filter("l_returnflag = 'R'"))


_GROUND = """
s AS (SELECT o_orderkey AS image, ['first ' || o_orderkey, 'second', 'third ' || o_orderstatus] AS expressions FROM orders),
i AS (SELECT DISTINCT l_orderkey AS image FROM lineitem WHERE l_linenumber < 7),
d AS (SELECT l_orderkey AS image, l_linenumber % 4 AS cls, l_partkey * 100000 + l_suppkey AS det_idx, l_quantity / 50.0::DOUBLE AS conf, l_tax * 1000 AS x1 FROM lineitem),
b AS (SELECT * FROM d WHERE conf > 0.1 QUALIFY row_number() OVER (PARTITION BY image, cls ORDER BY conf DESC, det_idx, x1) = 1),
f AS (SELECT s.image, b.cls, s.expressions[b.cls + 1] AS expr, round(b.conf, 4) AS conf, round(b.x1 / 640.0::DOUBLE, 6) AS x1 FROM s JOIN i USING (image) JOIN b USING (image) WHERE b.cls < 3)"""


def _grounded(spark, sf):
    samples = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string")).alias("image"), F.lit("").alias("caption"),
        F.array(F.concat(F.lit("first "), F.col("o_orderkey").cast("string")), F.lit("second"), F.concat(F.lit("third "), F.col("o_orderstatus"))).alias("expressions"),
    )
    li = table(spark, sf, "lineitem")
    images = li.filter("l_linenumber < 7").select(F.col("l_orderkey").cast("string").alias("name")).distinct()
    found = li.select(
        F.concat(F.lit("/data/"), F.col("l_orderkey").cast("string")).alias("image"), (F.col("l_linenumber") % 4).alias("cls"),
        F.struct((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("i"), (F.col("l_tax") * 1000).alias("x")).alias("det_idx"),
        (F.col("l_tax") * 1000).alias("x1"), F.lit(0.0).alias("y1"), F.lit(64.0).alias("x2"), F.lit(48.0).alias("y2"), (F.col("l_quantity") / 50.0).alias("conf"), F.lit(640).alias("w"), F.lit(480).alias("h"),
    )
    return regions.ground(samples, images, found)


@query(f"WITH {_GROUND} SELECT '/data/' || image AS image, expr, conf, x1 FROM f")
def grounding(spark, sf):
    got, _ = _grounded(spark, sf)
    return got.select("image", F.inline("regions")).select("image", "expr", "conf", F.round(F.get("bbox", F.lit(0)), 6).alias("x1"))


@query(
    f"""WITH {_GROUND} SELECT (SELECT count(DISTINCT image) FROM f) AS n_images, (SELECT count(*) FROM f) AS n_regions,
    (SELECT count(*) FROM s WHERE image NOT IN (SELECT image FROM i)) AS n_missing,
    (SELECT count(*) FROM s WHERE image IN (SELECT image FROM i) AND image NOT IN (SELECT image FROM f)) AS n_dropped"""
)
def grounding_report(spark, sf):
    return _grounded(spark, sf)[1]


@query("SELECT p_partkey AS image, c AS whole, CASE WHEN c THEN 7 * p_partkey ELSE p_size + 1 END AS tokens, c AS cached FROM part, (VALUES (true), (false)) t(c)")
def token_statistics(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), "p_size")
    cache = part.select("image", (F.col("image") * 7).alias("tokens"))
    runs = [packing.token_statistics(part, c, F.col("p_size") + 1).withColumn("whole", F.lit(w)) for c, w in ((cache, True), (cache.filter("image % 7 <> 0"), False))]
    return runs[0].unionByName(runs[1]).select("image", "whole", "tokens", "cached")


@query(
    """WITH c AS (SELECT conv_id, turn, length(text) % 9 + 1 AS n FROM conversations),
    o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS place FROM c)
    SELECT conv_id, string_agg(list_aggregate(list_transform(range(1, n + 1), lambda k: CAST(k * 10 + turn AS VARCHAR)), 'string_agg', ','), ',' ORDER BY turn) AS packed,
           string_agg(turn || ':' || n || ':' || place, ',' ORDER BY turn) AS grid, CAST(sum(n) AS INTEGER) AS n_patches FROM o GROUP BY conv_id"""
)
def collated_bins(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 9 + 1).cast("int").alias("n"))
    c = c.withColumn("patches", F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: k * 10 + F.col("turn")))
    got = packing.collate_bins(c, "conv_id", "turn", "patches", "turn", "n")
    said = F.transform("grid", lambda g: F.concat_ws(":", g["height"].cast("string"), g["width"].cast("string"), g["offset"].cast("string")))
    return got.select("conv_id", F.array_join(F.transform("packed", lambda x: x.cast("string")), ",").alias("packed"), F.array_join(said, ",").alias("grid"), "n_patches")


# --- defaults, profiles, bounds ------------------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, label, coalesce(teacher_score, CASE WHEN label = 1 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END) AS teacher_score, coalesce(conf, 0.5::DOUBLE) AS conf
    FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS label, CASE WHEN event_id % 3 <> 0 THEN value END AS teacher_score, CASE WHEN event_id % 4 <> 0 THEN value / 2 END AS conf FROM events)"""
)
def triplet_defaults(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", triplets.label_of(F.col("event_type"), "view").alias("label"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("teacher_score"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 2).alias("conf")
    )
    return triplets.with_defaults(rows)


@query("SELECT p_partkey, length(p_brand) >= 2 AND NOT regexp_matches(p_brand, '^(它|这个|那个|这些|那些|其|该)') AS ok FROM part")
def legacy_expression(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.valid_expression(F.col("p_brand"), F.lit(None).cast("string"), text.LEGACY_PROFILE).alias("ok"))


@query("SELECT p_partkey, '一个红色的' || p_size AS expr FROM part WHERE p_size % 2 = 0")
def attribute_fallback(spark, sf):
    said = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("路边有，一个红色的"), F.col("p_size").cast("string"), F.lit("。"))).otherwise(F.lit("nothing here"))
    rows = table(spark, sf, "part").select("p_partkey", said.alias("caption"))
    return regions.expressions(rows).select("p_partkey", F.explode("expressions").alias("expr"))


@query(
    """SELECT event_id, 'R' || i AS reason_id, CASE WHEN i <= event_id % 4 THEN 'e' || i ELSE '' END AS reason_text, CASE WHEN i <= event_id % 4 THEN 'relevant' ELSE 'irrelevant' END AS prior
    FROM events, range(1, 6) t(i) WHERE event_id % 4 > 0"""
)
def candidate_parse(spark, sf):
    rows = _answers(spark, sf).select("event_id", jsonx.extract_json(F.col("raw")).alias("j")).select("event_id", jsonx.parse_candidates(F.col("j")).alias("p"))
    return rows.filter("p.reason is null").select("event_id", F.inline("p.candidates"))


def _answers(spark, sf):
    """Answers of a model: an id for each of five reasons, none to three of them relevant."""
    n = (F.col("event_id") % 4).cast("int")
    said = lambda lo, hi: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: (i >= lo) & (i <= hi)), lambda i: F.concat(F.lit('{"id": "R'), i.cast("string"), F.lit('", "evidence": "e'), i.cast("string"), F.lit('"}'))), ", ")
    raw = F.concat(F.lit('answer: {"relevant": ['), said(F.lit(1), n), F.lit('], "irrelevant": ['), said(n + 1, F.lit(5)), F.lit("]}"))
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS image, event_type AS reason_id FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 3 = 0)")
def retry(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("image"), F.col("event_type").alias("reason_id"), "event_id")
    task = batch.TASKS["judge"]
    _, bad = batch.split_results(batch.infer(batch.keyed(e, task), task, batch.BACKENDS["echo"]()), task)
    return batch.retry_failures(bad, batch.keyed(e.filter("event_id % 3 = 0"), task)).select("image", "reason_id")


@query("SELECT event_id, round(exp(least(value, ln(100))), 6) AS scale, '<s>' || event_type || '</s>' AS said FROM events")
def scales_and_wraps(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(vectors.clamped_scale(F.col("value")), 6).alias("scale"), text.chat_wrap(F.col("event_type"), "<s>", "</s>").alias("said"))


@query("SELECT p_partkey, CAST(p_size * 28 // 14 AS INTEGER) AS gh, CAST(p_partkey % 900 // 14 AS INTEGER) AS gw, CAST((p_size * 28 // 14) * (p_partkey % 900 // 14) // 4 AS INTEGER) AS merged FROM part")
def grid_dimensions(spark, sf):
    g = geometry.grid(F.col("p_size") * 28, F.col("p_partkey") % 900)
    return table(spark, sf, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*")


@query("SELECT round(sum(greatest(-x, 0) + ln(1 + exp(-abs(x)))) / count(*) FILTER (WHERE d), 6) AS loss FROM (SELECT (CASE WHEN i = j THEN 1 ELSE -1 END) * (10 * s - 10) AS x, i = j AS d FROM (WITH " + _BATCHES + " SELECT * FROM sims WHERE j % 5 <> 0))")
def sigmoid_loss_valid_keys(spark, sf):
    import math

    return losses.pairwise_sigmoid(_batch_sims(spark, sf), math.log(10.0), -10.0, F.col("j") % 5 != 0).select(F.round("loss", 6).alias("loss"))


def _bounds_sql(order: str) -> str:
    return f"""SELECT source, count(*) AS n_items, CAST(sum(tokens) AS BIGINT) AS total, count(DISTINCT bin_id) AS n_bins, true AS each_once, true AS fits FROM ({_first_fit(order)}) GROUP BY source"""


def _bounds(bins):
    """The number of bins, and what any right packing keeps: every row once, and no bin over the budget but one of a single item."""
    per = bins.groupBy("source", "bin_id").agg(F.count("*").alias("c"), F.count_distinct("doc_id").alias("d"), F.sum("tokens").alias("t"))
    return per.groupBy("source").agg(
        F.sum("c").alias("n_items"), F.sum("t").alias("total"), F.count("*").alias("n_bins"), (F.sum("c") == F.sum("d")).alias("each_once"), F.bool_and((F.col("t") <= BUDGET) | (F.col("c") == 1)).alias("fits")
    )


@query(_bounds_sql("doc_id"))
def ffd_bounds(spark, sf):
    return _bounds(ffd_bins(spark, sf))


@query(_bounds_sql("sha1('42|' || doc_id)"))
def shuffled_bounds(spark, sf):
    return _bounds(shuffled_bins(spark, sf))


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS n_queries, true AS recall_of_nine_in_ten")
def ann_recall(spark, sf):
    near = ann_search(spark, sf).select("query_id", "vec_id").withColumn("_f", F.lit(1))
    got = topk_search(spark, sf).join(near, ["query_id", "vec_id"], "left")
    return got.agg(F.count_distinct("query_id").alias("n_queries"), (F.sum("_f") >= 0.9 * F.count("*")).alias("recall_of_nine_in_ten"))


@query(
    f"""WITH RECURSIVE {_RULES}, p AS (SELECT p_partkey, p_name, neg FROM made WHERE {_PLAUSIBLE}), {_ratios("SELECT p_name AS a, neg AS b FROM p")}
    SELECT p_partkey, neg, ratio >= 0.5 AS similar FROM p JOIN ratios ON a = p_name AND b = neg"""
)
def plausible_negatives(spark, sf):
    """Every plausible negative of every name, and whether it is similar enough."""
    made = negatives.rule_negatives(F.col("p_name"), text.RULES_ENGLISH)
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("expr"), F.explode(made).alias("neg"))
    return negatives.valid_negatives(rows, min_ratio=0.0).select("p_partkey", "neg", (F.col("ratio") >= negatives.MIN_RATIO).alias("similar"))


_DETECTED = f"""{_BOX}, d AS (SELECT p_partkey AS det_idx, p_partkey % 4 AS image, p_size % 3 AS cls, x1, y1, x2, y2, (p_partkey * 37 % 101) / 100.0::DOUBLE AS conf FROM x JOIN part USING (p_partkey)),
    r AS (SELECT *, row_number() OVER (PARTITION BY image, cls ORDER BY conf DESC, det_idx) AS r FROM d WHERE conf > 0.1)"""


@query(
    f"""WITH RECURSIVE {_DETECTED},
    k AS (SELECT image, cls, r, det_idx, true AS stays, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM r WHERE r = 1
      UNION ALL
      SELECT image, cls, r, det_idx, stays, CASE WHEN stays THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END FROM (
        SELECT r.*, k.kept, len(list_filter(k.kept, lambda b: greatest(0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0, least(b.y2, r.y2) - greatest(b.y1, r.y1))
          > 0.5 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(0, least(b.x2, r.x2) - greatest(b.x1, r.x1)) * greatest(0, least(b.y2, r.y2) - greatest(b.y1, r.y1))))) = 0 AS stays
        FROM k JOIN r ON r.image = k.image AND r.cls = k.cls AND r.r = k.r + 1))
    SELECT image, cls, det_idx FROM k WHERE stays"""
)
def suppressed_boxes(spark, sf):
    """Confidence above 0.1, then greedy suppression at 0.5; groups of more than 100 boxes go through the rounds."""
    sizes = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3).alias("cls"))
    boxes = _boxes(spark, sf).join(sizes, "p_partkey").select(F.col("p_partkey").alias("det_idx"), (F.col("p_partkey") % 4).alias("image"), "cls", "x1", "y1", "x2", "y2", ((F.col("p_partkey") * 37 % 101) / 100.0).alias("conf"))
    return regions.greedy_nms(boxes.filter("conf > 0.1"), 0.5, group_boxes=100).select("image", "cls", "det_idx")


def _bytes(value, n: int, little: bool = False):
    """A whole number as hexadecimal digits of ``n`` bytes."""
    digits = F.lpad(F.hex(value), 2 * n, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))]) if little else digits


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN NULL ELSE (['png', 'jpeg', 'bmp', 'webp', 'webp', 'webp', 'jpeg'])[CAST(p_partkey % 8 + 1 AS INTEGER)] END AS format,
    CASE WHEN p_partkey % 8 < 7 THEN CAST(p_size * 28 AS INTEGER) END AS width, CASE WHEN p_partkey % 8 < 7 THEN CAST(p_partkey % 900 + 1 AS INTEGER) END AS height FROM part"""
)
def image_headers(spark, sf):
    """Headers of every format, written byte by byte; JPEG segments of many lengths come before the frame. One in eight is cut off."""
    w, h, hx = F.col("p_size").cast("long") * 28, F.col("p_partkey") % 900 + 1, lambda x: F.lit(x)
    filler = F.col("p_partkey") % 300
    segment = lambda marker: F.concat(hx(f"FF{marker}"), _bytes(filler + 2, 2), F.expr("repeat('FF', int(p_partkey % 300))"))
    frame = lambda sof: F.concat(hx("FFD8"), segment("E0"), segment("E1"), hx("FFFF"), segment("C4").substr(F.lit(3), F.lit(10_000)), segment("DB"), hx(f"FF{sof}001108"), _bytes(h, 2), _bytes(w, 2), hx("03"))
    webp = lambda kind, rest: F.concat(hx("52494646"), hx("00000000"), hx("57454250"), hx(kind), hx("00000000"), rest)
    kinds = [
        F.concat(hx("89504E470D0A1A0A0000000D49484452"), _bytes(w, 4), _bytes(h, 4)),
        frame("C0"),
        F.concat(hx("424D"), F.repeat(hx("00"), 12), _bytes(F.lit(40), 4, True), _bytes(w, 4, True), _bytes(h, 4, True)),
        webp("56503858", F.concat(hx("00000000"), _bytes(w - 1, 3, True), _bytes(h - 1, 3, True))),
        webp("5650384C", F.concat(hx("2F"), _bytes((w - 1) + F.shiftleft(h - 1, 14), 4, True))),
        webp("56503820", F.concat(hx("000000"), hx("9D012A"), _bytes(w, 2, True), _bytes(h, 2, True))),
        F.concat(frame("C2").substr(F.lit(1), F.length(frame("C2"))), hx("00")),
        F.concat(hx("FFD8"), segment("E0")),
    ]
    content = F.unhex(F.get(F.array(*kinds), (F.col("p_partkey") % 8).cast("int")))
    return headers.with_sizes(table(spark, sf, "part").select("p_partkey", content.alias("content"))).select("p_partkey", "format", "width", "height")


@query(
    """WITH r AS (SELECT l_orderkey AS image, CAST(l_partkey AS VARCHAR) AS expr, min(l_quantity) AS conf FROM lineitem GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY expr) - 1 AS ri FROM r),
    n AS (SELECT l_orderkey AS image, l_linenumber - 1 AS ri, arg_max(l_suppkey, (l_suppkey, l_partkey)) AS hard FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
    SELECT p.image, p.expr, p.conf, CAST(n.hard AS VARCHAR) AS hard FROM p JOIN n ON p.image = n.image AND p.ri = n.ri"""
)
def region_assemble_by_position(spark, sf):
    """Negatives that name a region by its place; the last by supplier wins."""
    li = table(spark, sf, "lineitem")
    flat = li.groupBy(F.col("l_orderkey").alias("image"), F.col("l_partkey").cast("string").alias("expr")).agg(F.min("l_quantity").alias("conf"))
    entry = F.struct("expr", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"), "conf")
    nested = flat.groupBy("image").agg(F.array_sort(F.collect_list(entry)).alias("regions")).withColumn("caption", F.lit(""))
    neg = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") - 1).alias("ri"), F.array(F.col("l_suppkey").cast("string")).alias("hard"), F.struct("l_suppkey", "l_partkey").alias("ord"))
    return regions.assemble(nested, neg, by_position=True).select("image", F.inline("regions")).select("image", "expr", "conf", F.get("hard", F.lit(0)).alias("hard"))


_SAID = ("红色的{}", "红色的{}", "它", "路边", "路边有", "边有", "一个", "个红", "红色", "色的", "一个红", "个红色", "absent")
_SAID_SQL = ", ".join(f"replace('{x}', '{{}}', CAST(p_size AS VARCHAR))" for x in _SAID)


@query(
    f"""WITH c AS (SELECT p_partkey AS image, p_size, '路边有，一个红色的' || p_size || '。' AS caption FROM part WHERE p_partkey % 7 <> 0),
    g AS (SELECT image, u.e, u.i FROM c, unnest([{_SAID_SQL}]) WITH ORDINALITY AS u(e, i) WHERE p_size % 3 = 0 AND length(u.e) >= 2 AND contains(caption, u.e)),
    f AS (SELECT image, e, i FROM g QUALIFY row_number() OVER (PARTITION BY image, e ORDER BY i) = 1),
    t AS (SELECT image, e FROM f QUALIFY row_number() OVER (PARTITION BY image ORDER BY i) <= 8)
    SELECT image, e AS expr FROM t UNION ALL SELECT image, '一个红色的' || p_size FROM c WHERE p_size % 3 <> 0"""
)
def expressions_resumed(spark, sf):
    """Generated lines with repeats, invalid ones and more than the cap; one in three images has none and one in three
    none that is valid, so the pattern is used. One image in seven is done already."""
    size = F.col("p_size").cast("string")
    caption = F.concat(F.lit("路边有，一个红色的"), size, F.lit("。"))
    said = F.when(F.col("p_size") % 3 == 0, F.array(*[F.concat(F.lit(x.removesuffix("{}")), size) if "{}" in x else F.lit(x) for x in _SAID])).when(F.col("p_size") % 3 == 1, F.array(F.lit("不在其中")))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), caption.alias("caption"), said.alias("said"))
    return regions.expressions(rows, generated=F.col("said"), done=rows.filter("image % 7 = 0")).select("image", F.explode("expressions").alias("expr"))


@query(
    """SELECT CAST(event_id AS INTEGER) AS step, m AS metric, CASE WHEN m = 'hit@5' THEN value ELSE -value END AS value FROM events, (VALUES ('hit@5'), ('loss')) t(m) WHERE event_type = 'error'
    UNION ALL SELECT CAST(event_id AS INTEGER), 'final', value FROM events WHERE event_type <> 'error' AND event_id % 10 = 0"""
)
def evaluation_curve(spark, sf):
    """Rows with a loss are training; the others have a map of metrics, or a final one."""
    e = table(spark, sf, "events")
    maps = F.when(e["event_type"] == "error", F.create_map(F.lit("hit@5"), e["value"], F.lit("loss"), -e["value"]))
    final = F.when((e["event_type"] != "error") & (e["event_id"] % 10 == 0), F.create_map(F.lit("final"), e["value"]))
    loss = F.when((e["event_type"] != "error") & (e["event_id"] % 10 != 0), e["value"])
    return metrics.evaluation_curve(e.select(e["event_id"].cast("int").alias("step"), loss.alias("loss"), maps.alias("eval"), final.alias("final_eval")))


@query(
    """SELECT l_orderkey AS image, l_linenumber, 'R' || (l_suppkey % 7) AS reason_id, CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE coalesce(r_name, '') END AS reason_text
    FROM lineitem LEFT JOIN region ON r_regionkey = l_suppkey % 7"""
)
def reason_texts(spark, sf):
    """Candidates with and without evidence; two of the seven ids are in no library."""
    li = table(spark, sf, "lineitem")
    cands = li.select(F.col("l_orderkey").alias("image"), "l_linenumber", F.concat(F.lit("R"), (F.col("l_suppkey") % 7).cast("string")).alias("reason_id"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise("").alias("reason_text"))
    library = table(spark, sf, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("reason_id"), F.col("r_name").alias("rule"))
    return regions.with_reason_texts(cands, library)


@query(
    """SELECT p_size % 4 AS shard, count(*) AS n, count(DISTINCT p_brand) AS items, round(count(*) / count(DISTINCT p_brand), 4) AS per_item,
    CAST(min(t) AS BIGINT) AS least, CAST(max(t) AS BIGINT) AS most, round(avg(t), 6) AS mean FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 9 * p_partkey ELSE p_size + 1 END AS t FROM part WHERE p_partkey % 2 = 1) GROUP BY 1"""
)
def token_report(spark, sf):
    """The cache lacks half of the images, so all are counted anew; the report is by shard."""
    part = table(spark, sf, "part").filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("image"), "p_size", "p_brand", (F.col("p_size") % 4).alias("shard"))
    counted = packing.token_statistics(part, part.filter("image % 4 = 1").select("image", F.lit(0).alias("tokens")), F.col("p_size") + 1)
    return regions.count_report(counted, "p_brand", "tokens", ("shard",)).withColumn("mean", F.round("mean", 6))


@query(ORACLES["candidate_parse"])
def candidates_in_sql(spark, sf):
    """``candidate_parse`` as a table function."""
    table_functions.register(spark)
    _answers(spark, sf).createOrReplaceTempView("answers")
    return spark.sql("SELECT * FROM explode_candidates(TABLE(answers))")


@query(
    r"""WITH l AS (SELECT conv_id, turn, u.i, regexp_replace(regexp_replace(u.line, '^\s+|\s+$', '', 'g'), '^[0-9.、\-·* \t"''“”‘’]+|[0-9.、\-·* \t"''“”‘’]+$', '', 'g') AS line
        FROM conversations, unnest(string_split(CAST(turn AS VARCHAR) || '. ' || role || chr(10) || '- ' || text || chr(10) || '*', chr(10))) WITH ORDINALITY AS u(line, i))
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INTEGER) AS line_no, line FROM l WHERE line <> ''"""
)
def lines_in_sql(spark, sf):
    """The lines of a conversation, numbered through its turns by a table function over a partitioned table."""
    table_functions.register(spark)
    said = F.concat(F.col("turn").cast("string"), F.lit(". "), "role", F.lit("\n- "), "text", F.lit("\n*"))
    table(spark, sf, "conversations").select("conv_id", "turn", said.alias("raw")).createOrReplaceTempView("said")
    return spark.sql("SELECT * FROM explode_lines(TABLE(said) PARTITION BY conv_id ORDER BY turn)")

"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm import bpe, centroids, language, mixing, orderhash, periods, private, quality, ranking, repeats, simhash, toxicity, urls
from stationlake.llm.common import WORD, cut, documents, labels, remainder, small


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likenesses. Odd rows: see ``orderhash``."""
    return orderhash.compare(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; rows without an id are components of their own fingerprint."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by the rules, else by templates that learn from the labels of the documents that pages show."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return urls.judge(urls.tied(pages, documents(spark, sf_dir), labels(spark, sf_dir), bad).drop("html"), bad="bad")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the public vocabulary, their number, and digests of ids and of what they decode to."""
    import public_tokenizers as P

    vocabulary = P.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary, P.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labels outside the held-out fold; a null id is in no fold, and not learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 4) == 2
    scored = toxicity.score(docs, toxicity.learn(docs, labels(spark, sf_dir), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 200 bytes leave of every document."""
    gone = repeats.remove(documents(spark, sf_dir))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return gone.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its source's size and target."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    docs = cut(documents(spark, sf_dir).select("doc_id", words.alias("size"), F.array("source").alias("sources")))
    mixed, sizes, quota = mixing.mix(docs, "size", "sources", order=["doc_id", "size", "sources"])
    rows = [(s, n, float(quota[s])) for s, n in sizes.items()]
    of = spark.createDataFrame(rows, "s string, source_size long, target double")
    source = F.element_at("sources", 1)
    joined = mixed.join(small(of, len(rows)), source.eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules' verdict and the trees'."""
    judged = quality.rules(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality_score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document by machines of the documents outside the held-out fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    tree = language.learn(docs, ~held_out)
    predicted = language.predict(docs.select("doc_id", "text"), tree)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates for its entities, and their number."""
    return private.replace(documents(spark, sf_dir).select("doc_id", "text"), count="n_entities")


def op11_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by preferences among the labels outside the held-out fold; a null id is in no fold, and not learned from."""
    held_out = remainder(F.col("doc_id"), 5) == 0
    ranked = ranking.rank(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir), ~held_out)
    return ranked.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every sound vector, its distance, and what its cluster and all of them sum to."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assigned, found = centroids.cluster(vectors)
    sums = centroids.inertia(assigned)
    texts = centroids.digest(found)
    of = spark.createDataFrame([(c, n, sum(sums.values()), texts[c]) for c, n in sums.items()], "c int, cluster_inertia long, inertia long, t string")
    joined = assigned.join(F.broadcast(of), F.col("cluster") == F.col("c"))  # a row for each centroid
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("t", 256).alias("centroid_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which one in ten repeats its end as its id's checksum says; a null id changes nothing."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10).cast("long")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    docs = documents(spark, sf_dir).select("doc_id", "text", g.alias("g"), F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("words"))
    n = F.size("words").cast("long")
    placed = docs.withColumns({"a": F.col("g") % F.when(n > 0, n), "p": F.lit(None).cast("long")})
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    span = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(span, times)), F.lit(1), (n - F.col("a")).cast("int"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    found = periods.find(placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).cast("long").alias("exponent_milli"), F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"), "n_words",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_simhash": op2_simhash,
    "op3_url_filter": op3_url_filter,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_repeats": op6_repeats,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_surrogates": op10_surrogates,
    "op11_quality_ranking": op11_quality_ranking,
    "op12_centroids": op12_centroids,
    "op13_periodic_runs": op13_periodic_runs,
}


def _centroids_sql(rounds: int = 10, clusters: int = 8, components: int = 64) -> str:
    """The rounds one after the other; distances of whole numbers are exact in doubles as long as they are below 2^53."""
    near = "SELECT r, any_value(v) AS v, arg_min(c, (d, c)) AS c, CAST(min(d) AS BIGINT) AS d FROM (SELECT r, v, c, vv - 2 * list_inner_product(v, w) + ww AS d FROM vectors, c{0}) GROUP BY r"
    steps = [
        f"sound AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {components} AND list_count(embedding) = {components} AND len([x for x in embedding if isfinite(x)]) = {components})",
        "vectors AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS vv FROM (SELECT row_number() OVER () AS r, vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM sound))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS w, vv AS ww FROM vectors QUALIFY c < {clusters})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({near.format(i)})",
            f"m{i} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS w FROM (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(v) AS x, unnest(range({components})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT c, w, list_inner_product(w, w) AS ww FROM (SELECT o.c, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN m{i} m ON o.c = m.c))",
        ]
    steps.append(f"done AS MATERIALIZED ({near.format(rounds)})")
    texts = f"texts AS (SELECT c, sha256(array_to_string([CAST(x AS BIGINT) for x in w], ',')) AS centroid_sha256 FROM c{rounds})"
    last = "SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM done JOIN vectors USING (r) JOIN texts USING (c)"
    return f"WITH {', '.join([*steps, texts])} {last}"


ORACLES: dict[str, str] = {"op12_centroids": _centroids_sql()}

"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, classifier, codes, html, mixing, packing, periodic, quality, secrets, simhash, tokenfile, urls, vptree
from palimpsest.session import new_folder, table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file (the package is installed on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.ids_crc32(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), distance=2, shingle=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {k: secrets.count_of(F.col("found"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")}
    return found.select(
        "doc_id",
        *count.values(),
        F.sha2(secrets.written(secrets.base_only(F.col("found"))), 256).alias("base_sha256"),
        secrets.written(F.col("found")).alias("spans"),
    )


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), output=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    coding = tokenfile.Coding(vocabulary("word_bpe_49k.json"), spaced=False, end_id=2)
    tokenfile.write(table(spark, sf_dir, "documents"), folder, coding)
    return tokenfile.read(spark, folder, digest_only=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), output=["doc_id"])
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


#: The session's setting for the Parquet table of (term, weight) that urls are judged by; unset: ``urls.STRICT`` and ``SOFT``.
URL_TERMS = "spark.palimpsest.urlTerms"


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get(URL_TERMS, None)
    strict, soft = urls.vocabulary(spark.read.parquet(path)) if path else (urls.STRICT, urls.SOFT)
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), strict=strict, soft=soft)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coding = (vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), *coding)
    kept = encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)})
    decoded = bpe.decode(kept, *coding, carry=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which the words of every tenth document by its hash go round from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).select("*", F.floor(F.col("h") / 10).alias("g"), F.size("w").alias("n"))
    placed = chosen.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int").alias("a"))
    placed = placed.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    round_ = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    changed = F.array_join(F.slice(F.concat(F.slice("w", 1, F.col("a")), round_), 1, F.col("n")), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(with_planted_runs(table(spark, sf_dir, "documents")))
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("*", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_vptree": op4_vptree,
    "op5_html": op5_html,
    "op6_mix": op6_mix,
    "op7_tokens": op7_tokens,
    "op8_quality": op8_quality,
    "op9_urls": op9_urls,
    "op10_classifier": op10_classifier,
    "op11_bpe": op11_bpe,
    "op12_codes": op12_codes,
    "op13_runs": op13_runs,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op3_secrets": secrets.oracle(),
    "op4_vptree": vptree.oracle(),
    "op8_quality": quality.oracle(),
    "op9_urls": urls.oracle(),
    "op12_codes": codes.oracle(),
}

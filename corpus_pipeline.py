"""From raw documents to tokens: five operators in a row, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Rows without a doc_id
go with SimHash dedup, which names what stays by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from patchwell.llm import exact_dedup, language_id, mixing, sentencepiece_codec, simhash_dedup
from patchwell.llm.common import having_ids, sized, store, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language isn't told with a score of 0.4 or more go: null, empty, not one letter, or like no learned language.

    Ties go to the first language by name, so they don't matter here; repeated rows stay or go
    together; where no row has a language, all texts with a letter stay. Of very long texts all is counted. An empty table gives no rows.
    """
    return language_id.reject(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) one row stays: of those with the largest doc_id, or where none has an id.

    A row is selected by id and text: rows that share an id stay or go each with its text, and of rows that
    repeat both, or the text without an id, one stays. Long texts count whole. An empty table gives no rows.
    """
    found = store(exact_dedup.deduplicate(docs).select("doc_id", "keep_id", "kept", "text_sha256"), "found")
    ids = store(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("kept").alias("kept")).filter("kept"), "kept")
    rows = having_ids(docs, ids.filter("n = 1").select("doc_id"), "doc_id")
    again = ids.filter("n > 1").select("doc_id")
    pairs = store(having_ids(found.filter("kept"), again, "doc_id").unionByName(found.filter("keep_id IS NULL")).select("doc_id", "text_sha256").distinct(), "pairs")
    if pairs.isEmpty():
        return rows
    whole, text = F.struct("*").alias("row"), F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("text")
    some = having_ids(docs, again, "doc_id").unionByName(docs.filter("doc_id IS NULL")).select(whole, text)
    one = some.groupBy("row.doc_id", "text").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    wanted = pairs.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("text"))
    return rows.unionByName(one.join(wanted, (one["text"] == wanted["text"]) & one["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row with the smallest doc_id stays.

    Near is what op10 links: 4 or fewer differing bits of 64 over 4-word shingles. Texts without a
    word have one fingerprint, so one of them stays. Of rows that share an id those of other groups are judged with their group. Rows
    without a doc_id go; long texts count whole, and an empty table gives no rows.
    """
    found = store(simhash_dedup.near_duplicates(docs), "found")
    mine = F.col("doc_id") == F.col("component_id")
    ids = store(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(mine, F.col("fingerprint"))).alias("first")).filter("first IS NOT NULL"), "firsts")
    rows = having_ids(docs, ids.filter("n = 1").select("doc_id"), "doc_id")
    again = ids.filter("n > 1").select("doc_id", "first")
    if again.isEmpty():
        return rows
    some = having_ids(docs, again.select("doc_id"), "doc_id").select(F.struct("*").alias("row"), F.xxhash64(F.to_json(F.struct("*"))).alias("nth"))
    prints = simhash_dedup.fingerprints(some.select(F.col("nth").alias("doc_id"), "row.text")).distinct().select(F.col("doc_id").alias("nth"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("first"))
    one = some.join(prints, "nth").groupBy("row.doc_id", "first").agg(F.min_by("row", "nth").alias("row"))
    return rows.unionByName(one.join(again, ["doc_id", "first"], "left_semi").select("row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times, whatever names other columns have.

    Ties in size are in order of the id's md5. Rows that repeat doc_id, source and size share what the
    mix takes of them, so it stays at its targets. Null texts and texts without a word have size 0, very long ones their
    whole size. An empty table gives no rows.
    """
    mix, whole = mixing.mix(docs), F.struct("*").alias("row")
    taken = store(mix.groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")), "copies")
    once = taken.filter("n = 1 AND copies > 0").select(F.col("doc_id").alias("key"), "copies")
    times = docs.select(F.col("doc_id").alias("key"), whole).join(sized(once), "key").select("row", "copies")
    again = taken.filter("n > 1").select("doc_id")
    if not again.isEmpty():
        key = ["doc_id", "source", "size"]
        shared = having_ids(mix, again, "doc_id").groupBy(F.struct(*key).alias("key")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
        rows = having_ids(docs, again, "doc_id").select(F.struct("doc_id", "source", mixing.words(F.col("text")).alias("size")).alias("key"), whole).join(shared, "key")
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row.text")))
        share = F.floor(nth * F.col("copies") / F.col("n")) - F.floor((nth - 1) * F.col("copies") / F.col("n"))
        times = times.unionByName(rows.select("row", share.alias("copies")).filter("copies > 0"))
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and their digests for each row; null counts as the empty text, an empty table gives no rows.
    A very long text is encoded unit by unit.

    Workers remember few units here, as they also hold what the stages before have loaded.
    """
    return sentencepiece_codec.encode_decode(docs, tokenizer_path(), remember=6 << 20).drop("decoded")


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mixed), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned profiles, SimHash components and merges are not expressible; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None

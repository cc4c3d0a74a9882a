"""What several corpus operators share."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACES = "\\x20\\x09-\\x0D"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACES}]+|[{SPACES}]+\\z", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{SPACES}]+"))).cast("long")


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, so that a recomputed task draws the same."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * F.lit(2.0 ** -53)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _label): labelled documents that aren't held out. Label rows of one id are averaged, 0.5 and more is 1; null labels don't count."""
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        (F.avg(label) >= 0.5).cast("int").alias("_label")).where(~held_out(F.col("_id")))
    source = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).where(~held_out(F.col("_key")))
    # The labels grow with the documents, so they are never broadcast: small inputs are joined as large ones are.
    return source.hint("merge").join(marks, F.col("_key") == F.col("_id")).select("_id", "_text", "_label")


def bounded_sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows, chosen by a hash of id and text, so that every run takes the same."""
    if n <= most:
        return rows
    return rows.where(uniform(F.col("_id"), F.col("_text"), F.lit("sample")) < most / n)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores in front until no column of the frames is called so, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

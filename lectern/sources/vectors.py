"""The vector table: build, publish, upsert, verify."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import embedding_text, text_fields
from lectern.operators.embedding import Embed, HashedWords, embed_table
from lectern.operators.knn import knn_search
from lectern.plans.sizing import broadcast_within, spread_small, staged, top_per_group
from lectern.settings import BROADCAST_BYTES, EMBED_FIELDS, STORED_TEXT_CHARS

VERSION = (
    "version bigint, path string, kind string, id_col string, only_ok boolean, published_at timestamp, "
    "n_buckets int, buckets map<string,string>"
)
BUCKET = "__bucket"
FILES_PER_BUCKET = 8  # at most so many tasks write a bucket, so that one id with very many rows doesn't wait for one task
MOST_FILES = 4 * FILES_PER_BUCKET  # in a bucket; beyond, compaction shuffles it to FILES_PER_BUCKET
ID_BYTES = 64  # an id is reckoned with in a broadcast
MAX_FAILED = 0.5  # share of rows that may fail before a build is refused


def with_vectors(
    corpus: DataFrame,
    embed: Embed | None = None,
    dim: int = 64,
    limit: int | None = None,
    id_col: str = "doc_id",
    fields: Sequence[str] = EMBED_FIELDS,
    partitions: int | None = None,
    stored_chars: int | None = STORED_TEXT_CHARS,
    buckets: int | None = None,
) -> DataFrame:
    """Documents with any text, plus ``embedding, embed_ok, embedded_text, embedded_at``.

    The whole text is embedded; only the stored copy is cut (``stored_chars`` None: not at all). ``partitions`` spreads
    the documents over that many tasks before the embedding calls; by default only a table too
    small for the scan to split is spread. With ``buckets`` they are dealt into that many first, as
    stored text and vector would double what is moved, and the bucket is a column more.
    """
    docs = corpus.withColumn("__text", embedding_text(corpus, fields)).where("__text <> ''")
    if limit:
        docs = docs.orderBy(id_col).limit(limit)
    if buckets:
        docs = _dealt(docs, id_col, buckets, *text_fields(corpus, fields)).withColumn("__text", embedding_text(corpus, fields))
    else:
        docs = docs.repartition(partitions) if partitions else spread_small(docs)
    out = embed_table(docs, embed, dim, text_col="__text")
    stored = F.col("__text") if stored_chars is None else F.left("__text", F.lit(stored_chars))
    return out.withColumn("embedded_text", stored).withColumn("embedded_at", F.current_timestamp()).drop("__text")


def build_vector_table(
    corpus: DataFrame,
    root: str,
    mode: str = "overwrite",
    embed: Embed | None = None,
    dim: int = 64,
    limit: int | None = None,
    id_col: str = "doc_id",
    fields: Sequence[str] = EMBED_FIELDS,
    partitions: int | None = None,
    max_failed: float = MAX_FAILED,
    rejected: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Build and publish a version of the table at ``root``.

    With ``buckets`` the rows lie in that many folders by a hash of their id, and so do those upserted later: a read puts new
    rows in place in the folders that have some, the others are read as they are, and :func:`compact_vectors`
    rewrites the former alone. It costs one shuffle of the documents, before they are embedded (after, if ``partitions`` is given).

    ``upsert`` publishes the new rows alone; readers put them in place of those with the same ids, and
    :func:`compact_vectors` writes them out. Nothing is published if more than the share
    ``max_failed`` of the rows could not be embedded. Those that failed are appended to the table ``rejected``
    instead of being published; without one they are published with ``embed_ok`` false.
    """
    spark = corpus.sparkSession
    if mode == "upsert":
        buckets = versions(spark, root)[0].n_buckets
    # dealt rows lie in few tasks; where that leaves cores without work, rows are embedded first and move with their vectors
    enough = buckets and not partitions and spark.sparkContext.defaultParallelism <= buckets * FILES_PER_BUCKET
    built = with_vectors(corpus, embed, dim, limit, id_col, fields, partitions, buckets=buckets if enough else None)
    path = _written(built, root, id_col, buckets)
    folders = _folders(spark, path, buckets)
    if folders == {}:  # no rows, so no folders either
        path, folders, buckets = _written(built.drop(BUCKET).limit(0), root), None, None
    made = spark.read.schema(built.drop(BUCKET).schema).parquet(path).drop(BUCKET)
    failed = made.where(~F.col("embed_ok"))
    rows, bad = made.count(), failed.count()
    if bad > max_failed * rows:
        raise ValueError(f"{bad} of {rows} rows could not be embedded; nothing is published")
    if rejected and bad:
        failed.write.mode("append").parquet(rejected)
    _listed(spark, root, path, "rows" if mode == "upsert" else "table", id_col, bool(rejected), buckets, folders)
    return read_vectors(spark, root)


def publish(df: DataFrame, root: str) -> str:
    """Write ``df`` to a new folder, then append it to the version list: readers see the old table or the new one."""
    path = _written(df, root)
    _listed(df.sparkSession, root, path, "table", "doc_id", False)
    return path


def _written(df: DataFrame, root: str, id_col: str = "doc_id", buckets: int | None = None) -> str:
    path = f"{root}/data/{uuid.uuid4().hex}"
    if buckets:
        rows = df if BUCKET in df.columns else _dealt(df, id_col, buckets, "embedding")
        rows.write.partitionBy(BUCKET).parquet(path)
    else:
        df.write.parquet(path)
    return path


def _dealt(df: DataFrame, id_col: str, buckets: int, *also: str) -> DataFrame:
    """``df`` with its rows' bucket, shuffled so that at most FILES_PER_BUCKET tasks have rows of one; ``also`` tells rows of an id apart."""
    place = F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int")
    spread = F.pmod(F.xxhash64(id_col, *also), F.lit(FILES_PER_BUCKET))
    rows = df.withColumn(BUCKET, place).withColumn("__spread", spread)
    return rows.repartition(BUCKET, "__spread").drop("__spread")


def _folders(spark: SparkSession, path: str, buckets: int | None) -> dict[str, str] | None:
    """Which buckets the rows at ``path`` lie in, and where."""
    if not buckets:
        return None
    found = spark.read.schema(f"{BUCKET} int").parquet(path).distinct().collect()
    return {str(r[BUCKET]): path for r in found}


def _listed(
    spark: SparkSession, root: str, path: str, kind: str, id_col: str, only_ok: bool, n_buckets: int | None = None,
    buckets: dict[str, str] | None = None,
) -> None:
    """Append an entry. Its version is the time in nanoseconds; of two builds at once both are listed, by folder name."""
    row = (time.time_ns(), path, kind, id_col, only_ok, None, n_buckets, buckets)
    entry = spark.createDataFrame([row], VERSION).withColumn("published_at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").json(f"{root}/versions")


def versions(spark: SparkSession, root: str) -> list[Row]:
    """Entries of the version list that the present table is made of: a table, then the rows upserted since."""
    entries = spark.read.schema(VERSION).json(f"{root}/versions").orderBy("version", "path").collect()
    last = max(i for i, e in enumerate(entries) if e.kind != "rows")
    return entries[last:]


def _part(spark: SparkSession, entry: Row, buckets: Iterable[str] | None = None, named: bool = False) -> DataFrame:
    """Rows of an entry, or those in some of its buckets; with their bucket if it shall be ``named``."""
    if entry.buckets is None:
        rows = spark.read.parquet(entry.path)
    else:
        wanted = entry.buckets.keys() if buckets is None else set(buckets) & entry.buckets.keys()
        by_folder: dict[str, list[str]] = {}
        for b in sorted(wanted or list(entry.buckets)[:1], key=int):
            by_folder.setdefault(entry.buckets[b], []).append(f"{entry.buckets[b]}/{BUCKET}={b}")
        parts = [spark.read.option("basePath", folder).parquet(*paths) for folder, paths in by_folder.items()]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows = rows if wanted else rows.limit(0)
    rows = rows.where("embed_ok") if entry.only_ok else rows
    return rows if named else rows.drop(BUCKET)


def _changed(spark: SparkSession, base: Row, newer: Sequence[Row]) -> tuple[DataFrame, set[str] | None]:
    """The table's rows in the buckets that upserted rows lie in (all of them where there are no buckets), and which these are."""
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [_part(spark, e).withColumn("__version", F.lit(i)) for i, e in enumerate(newer)])
    touched = _touched(base, newer)
    return upsert_vectors(_part(spark, base, touched), rows, base.id_col, _newest(), rows.count()).drop("__version"), touched


def _touched(base: Row, newer: Sequence[Row]) -> set[str] | None:
    return None if base.buckets is None else {b for e in newer for b in e.buckets or {}}


def _newest() -> list[Column]:
    return [F.desc("__version"), F.desc("embedded_at")]


def _merged(spark: SparkSession, root: str, base: Row, newer: Sequence[Row], touched: set[str]) -> str:
    """Write the present rows of the buckets ``touched`` to a new folder.

    A row's bucket stays what it is, so rows are written by the tasks that read them; only the ids of upserted
    rows are shuffled, and rows of an id that was upserted several times. Old rows meet the ids by broadcast, for as
    many buckets at a time as the limit allows. A bucket of very many small files is shuffled whole, to few.
    """
    path, id_col = f"{root}/data/{uuid.uuid4().hex}", base.id_col

    def upserted(some: Iterable[str]) -> DataFrame:
        parts = [_part(spark, e, some, True).withColumn("__version", F.lit(i)) for i, e in enumerate(newer) if e.buckets]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    ids = staged(upserted(touched).groupBy(BUCKET, id_col).agg(F.count("*").alias("n")), "upserted")
    counts = {str(r[BUCKET]): (r.ids, r.repeated) for r in ids.groupBy(BUCKET).agg(
        F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("repeated")).collect()}
    files: dict[str, int] = {}
    for f in _part(spark, base, touched, True).inputFiles():
        b = f.split(f"/{BUCKET}=")[1].split("/")[0]
        files[b] = files.get(b, 0) + 1
    # buckets whose ids are broadcast together; crowded ones apart, as they are shuffled
    passes: list[tuple[bool, int, list[str]]] = []
    for crowded, b in sorted((files.get(b, 0) > MOST_FILES, b) for b in touched):
        n = counts.get(b, (0, 0))[0]
        if passes and passes[-1][0] == crowded and (passes[-1][1] + n) * ID_BYTES <= BROADCAST_BYTES:
            passes[-1] = (crowded, passes[-1][1] + n, [*passes[-1][2], b])
        else:
            passes.append((crowded, n, [b]))
    for crowded, n, some in passes:
        here = ids.where(F.col(BUCKET).isin([int(b) for b in some]))
        rows, again = upserted(some), here.where("n > 1").select(F.col(id_col).alias("__again"))
        if repeated := sum(counts.get(b, (0, 0))[1] for b in some):
            again = broadcast_within(again, repeated, ID_BYTES)
            same = rows[id_col].eqNullSafe(again["__again"])
            tie = F.xxhash64(*[c for c in rows.columns if c not in (id_col, BUCKET)])  # as readers break ties
            first = top_per_group(rows.join(again, same, "left_semi"), [id_col], [*_newest(), tie], 1, rank="__n").drop("__n")
            rows = rows.join(again, same, "left_anti").unionByName(first)
        known = broadcast_within(here.select(id_col), n, ID_BYTES)
        old = _part(spark, base, some, True).join(known, id_col, "left_anti")
        rows = old.unionByName(rows.drop("__version"), allowMissingColumns=True)
        if crowded:
            rows = _dealt(rows, id_col, base.n_buckets, "embedding")
        rows.write.mode("append").partitionBy(BUCKET).parquet(path)
    return path


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """The table as last published: newer rows in place of older ones with the same id."""
    base, *newer = versions(spark, root)
    if not newer:
        return _part(spark, base)
    rows, touched = _changed(spark, base, newer)
    if touched is None or not base.buckets.keys() - touched:
        return rows
    return _part(spark, base, base.buckets.keys() - touched).unionByName(rows, allowMissingColumns=True)


def compact_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Write upserted rows in place as a new version, so that readers need not.

    Of a table with buckets only those that have upserted rows are written, else the whole table.
    """
    base, *newer = versions(spark, root)
    if newer:
        touched = _touched(base, newer)
        if touched == set():  # nothing was upserted
            return read_vectors(spark, root)
        path = _written(_changed(spark, base, newer)[0], root) if touched is None else _merged(spark, root, base, newer, touched)
        folders = None if touched is None else {**base.buckets, **_folders(spark, path, base.n_buckets)}
        only_ok = base.only_ok and touched is not None  # buckets that stay may hold rows that failed
        _listed(spark, root, path, "table", base.id_col, only_ok, base.n_buckets, folders)
    return read_vectors(spark, root)


def unused_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders of versions that the present table does not need: safe to remove once no reader has them open."""
    now = versions(spark, root)
    used = {e.path for e in now if e.buckets is None} | {f for e in now for f in (e.buckets or {}).values()}
    rows = spark.read.schema(VERSION).json(f"{root}/versions").select("path").collect()
    return sorted({r.path for r in rows} - used)


def upsert_vectors(
    old: DataFrame, new: DataFrame, id_col: str = "doc_id", newest: Column | Sequence[Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``new`` replaces rows of ``old`` with the same id; of equal ids in ``new`` the first by ``newest`` wins.

    Only ids of ``new`` meet the old table, so its vectors are shuffled only where
    those ids are too many to broadcast. ``rows`` is the known number of rows of ``new``; without it Spark
    goes by its own reckoning, which is far too high for ids of wide rows.
    """
    order = [newest] if isinstance(newest, Column) else list(newest or [])
    tie = F.xxhash64(*[c for c in new.columns if c != id_col])
    once = top_per_group(new, [id_col], [*order, tie], 1, rank="__n").drop("__n")
    ids = new.select(id_col).distinct()
    kept = old.join(ids if rows is None else broadcast_within(ids, rows, ID_BYTES), id_col, "left_anti")
    return kept.unionByName(once, allowMissingColumns=True)


def verify_vectors(
    table: DataFrame, dim: int = 64, vector_col: str = "embedding", text_col: str | None = "embedded_text"
) -> DataFrame:
    """One row of checks: ``docs, wrong_length, zero_vectors, no_text``."""
    vector = F.col(vector_col)
    wrong = F.coalesce(F.size(vector) != dim, F.lit(True)) | vector.isNull()
    zero = F.coalesce(F.forall(vector, lambda x: x == 0), F.lit(False))
    no_text = F.count_if(F.col(text_col).isNull()) if text_col in table.columns else F.lit(0).cast("bigint")
    return table.agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(wrong).alias("wrong_length"),
        F.count_if(zero).alias("zero_vectors"),
        no_text.alias("no_text"),
    )


def try_search(table: DataFrame, text: str, embed: Embed | None = None, dim: int = 64, k: int = 3) -> DataFrame:
    """The ``k`` nearest documents to one text: a quick look after a build."""
    one = table.sparkSession.createDataFrame([(0, text)], "qid bigint, query string")
    asked = embed_table(one, embed or HashedWords(dim), dim, text_col="query", vector_col="vector")
    return knn_search(table, asked, k)


def ingest_report(table: DataFrame, ok_col: str = "embed_ok") -> DataFrame:
    """Rows per outcome with their share: ``status, docs, percent``."""
    status = F.when(F.col(ok_col), F.lit("indexed")).otherwise(F.lit("error"))
    counts = table.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("docs"))
    total = counts.agg(F.sum("docs")).scalar()
    return counts.select("status", "docs", F.round(F.col("docs") * 100.0 / total, 1).alias("percent"))


def quarantine(table: DataFrame, path: str, ok_col: str = "embed_ok") -> DataFrame:
    """Append rows that failed to ``path`` and return the others. ``table`` is a written one: it is read twice."""
    table.where(~F.col(ok_col)).write.mode("append").parquet(path)
    return table.where(F.col(ok_col))

"""BM25 over an inverted index that is kept as tables.

The chunks of a workspace are dealt to blocks by a hash, the blocks to buckets, and the corpus is
shuffled once to buckets: a term's postings of a block lie together, and a search computes a chunk's
scores where the chunk lies, so that only the best k rows per query and bucket travel.

Files are bounded by segments. A workspace with more than a fixed share of all chunks has a segment
of its own, all others share segments by a hash. A refresh adds the postings of the workspaces it is
given under a new run number and leaves all other files alone: every workspace has one current run,
and postings of earlier runs meet no query. Compaction deletes them once enough runs have come. A
manifest names the live files, so a reader sees the index before a change or after it.

For large searches `top_k` reads the bounds of blocks first (the most that a term can add to a chunk
of the block): a block whose bounds add up to less than the k-th best score found is not scored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.text import Tokenizer, tokenize
from groundwell.session import fits_broadcast, materialize, scratch_dir
from groundwell.sources import manifest

# The usual Okapi parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25
# Scores are compared at this precision, so equal texts tie however their sums were ordered.
TIE_DIGITS = 9
# Pairs of a posting and a query that a single join task should see at most, and either side's share.
PAIRS_PER_TASK = 2_000_000
SIDE = 1_000
# Query terms up to which a batch is broadcast (about 20 MB).
QUERY_TERMS = 200_000
# Workspaces of a request batch up to which the others are left out of the scan.
SPACES = 1_000
# Shared segments; a workspace with more than one part in SEGMENTS of all chunks has one of its own.
SEGMENTS = 32
# Refreshes that may wait for compaction.
DELTAS = 8
# Chunks a block holds about.
BLOCK = 64
# Bytes of text that a bucket holds at most, about: the postings of 16 MB take about 200 MB to sort in memory.
BUCKET_TEXT = 16_000_000
# Buckets that Spark lets a table have, unless it is told otherwise.
BUCKETS = 100_000
# Chunks whose terms are counted at a time.
ROWS = 1_000
# Pairs of a posting and a query from which on blocks are bounded before they are scored.
PRUNE_FROM = 20_000_000
# Pairs of a query and a block that are broadcast at most (about 20 MB).
BLOCK_PAIRS = 200_000

POSTINGS = "chunk_id {id}, dl INT, term STRING, tf BIGINT, workspace_id STRING, run INT, block INT, part STRING"
BLOCKS = "workspace_id STRING, run INT, block INT, term STRING, df BIGINT, dl BIGINT, max_tf BIGINT, min_dl INT, part STRING"
COUNTS = "workspace_id STRING, run INT, term STRING, df BIGINT, dl BIGINT, part STRING"
CORPUS = "workspace_id STRING, run INT, n BIGINT, avgdl DOUBLE, floor DOUBLE"
DELTA = "d"


@dataclass(frozen=True)
class LexicalIndex:
    """postings(workspace_id, run, block, chunk_id, dl, term, tf), blocks(workspace_id, run, block, term, df,
    dl, max_tf, min_dl), counts(workspace_id, run, term, df) of all live files, and of every workspace the
    current run: corpus(workspace_id, run, n, avgdl, floor). Rows of other runs are dead."""

    postings: DataFrame
    blocks: DataFrame
    counts: DataFrame
    corpus: DataFrame
    state: dict

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        """The index at this path, in its state of now."""
        _, state = manifest.latest(spark, path)
        with_term = F.col("term").isNotNull()
        live = F.col("part").isin(state["parts"]) if state["parts"] else F.lit(False)
        frames = (_postings_at(spark, path, state), _read(spark, path, "blocks"), _read(spark, path, "counts"))
        corpus = spark.read.schema(CORPUS).parquet(*(f"{path}/corpus/{c}" for c in state["corpus"]))
        if len(state["corpus"]) > 1:
            row = F.max_by(F.struct("run", "n", "avgdl", "floor"), "run")
            corpus = corpus.groupBy("workspace_id").agg(row.alias("r")).select("workspace_id", "r.*")
        return LexicalIndex(*(f.where(live & with_term) for f in frames), corpus.where("n IS NOT NULL"), state)

    @property
    def terms(self) -> DataFrame:
        """(workspace_id, term, df) of the current runs."""
        found = self.counts.select("workspace_id", "run", "term", "df")
        if len(self.state["corpus"]) > 1:
            found = found.join(self.corpus.select("workspace_id", "run"), ["workspace_id", "run"], "left_semi")
        return found.drop("run")

    def asked_by(self, queries: DataFrame) -> LexicalIndex:
        """The index without the files of workspaces that no query asks for, if the queries ask for few."""
        found = queries.select("workspace_id", _segment(self.state).alias("segment")).distinct().limit(SPACES + 1).collect()
        if len(found) > SPACES:
            return self
        segments = {r["segment"] for r in found} | {DELTA}
        parts = [p for p in self.state["parts"] if _segment_of(p) in segments]
        here = F.col("workspace_id").isin([r["workspace_id"] for r in found]) & (F.col("part").isin(parts) if parts else F.lit(False))
        return replace(self, postings=self.postings.where(here), blocks=self.blocks.where(here), counts=self.counts.where(here))


def _table_name(path: str) -> str:
    return "lexical_" + hashlib.sha1(path.encode()).hexdigest()[:20]


def _postings_at(spark: SparkSession, path: str, state: dict) -> DataFrame:
    """The postings at `path`; a session that did not write them declares their table."""
    name = _table_name(path)
    if spark.catalog.tableExists(name):
        spark.catalog.refreshTable(name)
    else:
        spark.sql(
            f"CREATE TABLE {name} ({POSTINGS.format(id=state['id_type'])}) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY (workspace_id, block) SORTED BY (workspace_id, term) INTO {state['buckets']} BUCKETS "
            f"LOCATION '{path}/postings'"
        )
    known = {r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    missing = " ".join(f"PARTITION (part='{p}')" for p in state["parts"] if p not in known)
    if missing:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {missing}")
    return spark.table(name)


def _read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema({"blocks": BLOCKS, "counts": COUNTS}[table]).parquet(f"{path}/{table}")


def _segment(state: dict) -> Column:
    """Segment of a row's workspace: w and a number for one of its own, h and a number for a shared one."""
    space, own = F.col("workspace_id"), state["own"]
    shared = F.concat(F.lit("h"), F.pmod(F.xxhash64(space), F.lit(state["segments"])))
    if not own:
        return shared
    return F.when(space.isin(own), F.concat(F.lit("w"), F.array_position(F.lit(own), space))).otherwise(shared)


def _segment_of(part: str) -> str:
    return part.partition("-")[0]


def _corpus(counts: DataFrame) -> DataFrame:
    """One row per workspace from the counts per term; the count without a term holds the
    chunks and their lengths.

    The mean idf comes from the histogram of df values: the term table, which may lie in
    one workspace for the most part, is never moved by workspace.
    """
    sizes = counts.where(F.col("term").isNull()).select(
        "workspace_id", "run", F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl")
    )
    histogram = counts.where(F.col("term").isNotNull()).groupBy("workspace_id", "df").agg(
        F.count(F.lit(1)).alias("m")
    )
    return histogram.join(sizes, "workspace_id").groupBy("workspace_id", "run", "n", "avgdl").agg(
        (F.sum(F.col("m") * raw_idf()) / F.sum("m") * EPSILON).alias("floor")
    )


def _text(context: str | None) -> Column:
    """What is indexed of a chunk."""
    text = F.col("content")
    if context is None:
        return text
    return F.when(F.coalesce(F.col(context), F.lit("")) != "", F.concat(F.col(context), F.lit("\n"), text)).otherwise(text)


def _postings(chunks: DataFrame, sizes: DataFrame, tokenizer: Tokenizer, context: str | None, buckets: int) -> DataFrame:
    """Postings of `chunks`, dealt to blocks; `sizes` (workspace_id, chunks, copies) has the chunks of each workspace
    and the most rows that a chunk id has in it."""
    blocks = sizes.where(F.col("chunks") > BLOCK).select(
        "workspace_id", F.ceil(F.col("chunks") / BLOCK).cast("int").alias("blocks")
    )
    texts = (
        chunks.select("workspace_id", "chunk_id", _text(context).alias("content"))
        .join(F.broadcast(blocks) if fits_broadcast(blocks) else blocks, "workspace_id", "left")
        .withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
        .drop("blocks")
        .repartition(buckets, "workspace_id", "block")
    )
    tokens = texts.select(
        "workspace_id", "block", "chunk_id", tokenizer(F.col("content")).alias("tokens")
    ).withColumn("dl", F.size("tokens"))
    # Each chunk also gets one posting without a term, which carries its length into the
    # one pass over the postings that counts terms.
    if sizes.where(F.col("copies") > 1).isEmpty():
        id_type = chunks.schema["chunk_id"].dataType.simpleString()
        return tokens.mapInArrow(
            _counted, f"workspace_id string, block int, chunk_id {id_type}, dl int, term string, tf bigint"
        )
    # Rows of one chunk id count as one chunk if they are equally long. An outer explode, as the
    # plain one would infer a filter that tokenizes every text a second time.
    return (
        tokens.select(
            "workspace_id",
            "block",
            "chunk_id",
            "dl",
            F.explode_outer(F.array_append("tokens", F.lit(None).cast("string"))).alias("term"),
        )
        .groupBy("workspace_id", "block", "chunk_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows that are a chunk each, a bounded number of rows at a time, by workspace and term: of
    such runs, the sort before they are written has little left to do."""
    names = ["workspace_id", "block", "chunk_id", "dl"]
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            n, tokens = rows.num_rows, rows.column("tokens")
            words = pc.list_flatten(tokens).dictionary_encode()
            spaces = pc.rank(rows.column("workspace_id"), tiebreaker="dense")
            owners = _numbers(pc.list_parent_indices(tokens))
            # Places of terms in their order; place 0 is the posting without a term.
            order = pc.sort_indices(words.dictionary)
            width, place = len(order) + 1, np.zeros(len(order) + 1, np.int64)
            place[_numbers(order)] = np.arange(1, width)
            places = np.concatenate([place[_numbers(pc.fill_null(words.indices, -1))], np.zeros(n, np.int64)])
            owners = np.concatenate([owners, np.arange(n, dtype=np.int64)])
            keys = (_numbers(spaces)[owners] * width + places) * n + owners
            keys, tf = np.unique(keys, return_counts=True)
            places = keys // n % width
            term = words.dictionary.take(order).take(pa.array(places - 1, mask=places == 0))
            found = rows.select(names).take(pa.array(keys % n))
            yield pa.RecordBatch.from_arrays([*found.columns, term, pa.array(tf, pa.int64())], [*names, "term", "tf"])


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("part").parquet(path)


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _insert(rows: DataFrame, path: str, tag: str) -> list[str]:
    """Write postings into parts of this tag and return the parts that came about."""
    spark, name = rows.sparkSession, _table_name(path)
    rows.select(*_columns(POSTINGS)).write.insertInto(name)
    spark.catalog.refreshTable(name)
    found = [f.partition("=")[2] for f in manifest.listed(spark, f"{path}/postings")]
    return sorted(p for p in found if p.endswith(f"-{tag}"))


def _add_run(
    chunks: DataFrame, sizes: DataFrame, path: str, state: dict, tokenizer: Tokenizer, context: str | None, shared: Column
) -> tuple[list[str], DataFrame]:
    """Write the postings of `chunks` as a new run, with the statistics of its workspaces. `shared` is the segment
    that workspaces without one of their own go to."""
    spark = chunks.sparkSession
    tag = f"{state['run']}-{uuid.uuid4().hex[:12]}"
    segment = F.when(F.col("workspace_id").isin(state["own"]), _segment(state)).otherwise(shared) if state["own"] else shared
    fresh = _postings(chunks, sizes, tokenizer, context, state["buckets"]).withColumn("run", F.lit(state["run"]))
    parts = _insert(fresh.withColumn("part", F.concat(segment, F.lit(f"-{tag}"))), path, tag)
    here = F.col("part").isin(parts) if parts else F.lit(False)
    # A block lies in one bucket, so this moves nothing.
    blocks = (
        spark.table(_table_name(path))
        .where(here & (F.col("dl") > 0))
        .groupBy("workspace_id", "block", "term", "run", "part")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("dl"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    )
    _append(blocks.select(*_columns(BLOCKS)), f"{path}/blocks")
    counts = (
        _read(spark, path, "blocks").where(here).groupBy("workspace_id", "run", "term", "part")
        .agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))
    )
    _append(counts.select(*_columns(COUNTS)), f"{path}/counts")
    return parts, _corpus(_read(spark, path, "counts").where(here))


def _sizes(chunks: DataFrame, text: Column | None = None) -> DataFrame:
    """(workspace_id, chunks, copies, bytes): rows, the most rows of a chunk id, and bytes of `text`, if given."""
    length = F.lit(0) if text is None else F.octet_length(text)
    ids = chunks.groupBy("workspace_id", "chunk_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(length).alias("bytes"))
    sizes = ids.groupBy("workspace_id").agg(
        F.sum("rows").alias("chunks"), F.max("rows").alias("copies"), F.sum("bytes").alias("bytes")
    )
    return materialize(sizes, "index-sizes")


def _large(sizes: DataFrame, total: int, segments: int) -> list[str]:
    """Workspaces with more than one part in `segments` of all chunks: fewer than `segments`."""
    rows = sizes.where((F.col("chunks") > total / segments) & F.col("workspace_id").isNotNull())
    return sorted(r["workspace_id"] for r in rows.collect())


def build_index(
    chunks: DataFrame,
    tokenizer: Tokenizer = tokenize,
    context: str | None = None,
    path: str | None = None,
    partitions: int | None = None,
    segments: int = SEGMENTS,
) -> LexicalIndex:
    """Index the chunks that have tokens, at a new `path` (by default in scratch space). With
    `context`, the generated context of a chunk is indexed in front of its text.

    The text is shuffled once, to buckets of blocks, before it is tokenized; each task then writes its
    bucket, a file per segment: no more than 2 * segments * buckets in all, however many workspaces there
    are. There are `partitions` buckets, and more for texts of more than `BUCKET_TEXT` bytes a bucket, so
    that a task's postings can be sorted in memory however large the corpus is. Nothing is kept in memory,
    and later sessions load the index.
    """
    spark = chunks.sparkSession
    path = path or scratch_dir(spark, "index")
    sizes = _sizes(chunks, _text(context))
    total, size = (n or 0 for n in sizes.agg(F.sum("chunks"), F.sum("bytes")).first())
    state = {
        "buckets": max(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // BUCKET_TEXT), BUCKETS)),
        "id_type": chunks.schema["chunk_id"].dataType.simpleString(),
        "segments": segments, "own": _large(sizes, total, segments), "run": 0, "parts": [], "corpus": [],
    }
    _postings_at(spark, path, state)
    state["parts"], corpus = _add_run(chunks, sizes, path, state, tokenizer, context, _segment(state))
    return _commit(path, 0, state, corpus, [])


def _commit(path: str, version: int, state: dict, corpus: DataFrame, earlier: list[str]) -> LexicalIndex:
    name = uuid.uuid4().hex
    corpus.select(*_columns(CORPUS)).write.parquet(f"{path}/corpus/{name}")
    manifest.commit(corpus.sparkSession, path, version, state | {"corpus": [*earlier, name]})
    return LexicalIndex.load(corpus.sparkSession, path)


def refresh_index(
    spark: SparkSession,
    path: str,
    chunks: DataFrame,
    workspaces: DataFrame,
    tokenizer: Tokenizer = tokenize,
    context: str | None = None,
) -> LexicalIndex:
    """Index the given workspaces (workspace_id) anew from `chunks`; the postings of others are neither read nor
    written, but for a compaction after every few refreshes.

    A workspace of which nothing is left is no longer found. A workspace that has grown past the share
    gets a segment of its own. A refresh that failed left the index as it was and is simply run
    again; of two refreshes at once one fails.
    """
    version, state = manifest.latest(spark, path)
    index = LexicalIndex.load(spark, path)
    asked = workspaces.select("workspace_id").distinct()
    touched = chunks.join(F.broadcast(asked) if fits_broadcast(asked) else asked, "workspace_id", "left_semi")
    sizes = _sizes(touched)
    came = sizes.agg(F.sum("chunks")).first()[0] or 0
    total = max(came, index.corpus.agg(F.sum("n")).first()[0] or 0)
    grown = [w for w in _large(sizes, total, state["segments"]) if w not in state["own"]]
    state |= {"own": state["own"] + grown, "run": state["run"] + 1}
    parts, corpus = _add_run(touched, sizes, path, state, tokenizer, context, F.lit(DELTA))
    state["parts"] = state["parts"] + parts
    # Every asked workspace gets a row: without chunks it says that earlier runs are dead.
    current = asked.join(corpus.drop("run"), "workspace_id", "left").withColumn("run", F.lit(state["run"]))
    fresh = _commit(path, version + 1, state, current, state["corpus"])
    return compact_index(spark, path) if len(state["corpus"]) > DELTAS else fresh


def compact_index(spark: SparkSession, path: str) -> LexicalIndex:
    """Bring every live row to its workspace's segment and leave dead ones out.

    Only segments of which a workspace was refreshed since the last time are read and written.
    """
    version, state = manifest.latest(spark, path)
    index = LexicalIndex.load(spark, path)
    if len(state["corpus"]) == 1:
        return index
    rows = spark.read.schema(CORPUS).parquet(*(f"{path}/corpus/{c}" for c in state["corpus"][1:]))
    # A refreshed workspace has rows in its own or shared segment, in deltas, or, before it grew, in a shared one.
    both = F.array(_segment(state), _segment(state | {"own": []}))
    segments = {r[0] for r in rows.select(F.explode(both)).distinct().collect()} | {DELTA}
    old = [p for p in state["parts"] if _segment_of(p) in segments]
    tag = f"{state['run']}-{uuid.uuid4().hex[:12]}"
    part = F.concat(_segment(state), F.lit(f"-{tag}"))
    current = index.corpus.select("workspace_id", "run")
    current = F.broadcast(current) if fits_broadcast(current) else current

    def live(frame: DataFrame) -> DataFrame:
        found = frame.where(F.col("part").isin(old)) if old else frame.limit(0)
        return found.join(current, ["workspace_id", "run"], "left_semi").withColumn("part", part)

    buckets = live(spark.table(_table_name(path))).repartition(state["buckets"], "workspace_id", "block")
    parts = _insert(buckets, path, tag)
    for table, schema in (("blocks", BLOCKS), ("counts", COUNTS)):
        _append(live(_read(spark, path, table)).select(*_columns(schema)), f"{path}/{table}")
    state["parts"] = [p for p in state["parts"] if p not in old] + parts
    return _commit(path, version + 1, state, index.corpus, [])


def clean_index(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete manifests but the last `keep`, and the files that none of those names. Not beside a refresh."""
    found = manifest.names(spark, path)
    states = [manifest.state(spark, path, n) for n in found[-keep:]]
    parts = {p for s in states for p in s["parts"]}
    for table in ("postings", "blocks", "counts"):
        for folder in manifest.listed(spark, f"{path}/{table}"):
            if folder.startswith("part=") and folder.partition("=")[2] not in parts:
                manifest.delete(spark, f"{path}/{table}/{folder}")
    for folder in set(manifest.listed(spark, f"{path}/corpus")) - {c for s in states for c in s["corpus"]}:
        manifest.delete(spark, f"{path}/corpus/{folder}")
    for name in found[:-keep]:
        manifest.delete(spark, f"{path}/manifest/{name}")


def raw_idf() -> Column:
    return F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def idf() -> Column:
    """idf over the columns n, df and floor: a negative value becomes the floor."""
    return F.when(raw_idf() < 0, F.col("floor")).otherwise(raw_idf())


def query_terms(queries: DataFrame, tokenizer: Tokenizer = tokenize) -> DataFrame:
    """(query_id, workspace_id, term, qtf): repeated query tokens count each time."""
    return (
        queries.select("query_id", "workspace_id", F.explode_outer(tokenizer(F.col("query"))).alias("term"))
        .groupBy("query_id", "workspace_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _wanted(index: LexicalIndex, asked: DataFrame, small: bool = False) -> DataFrame:
    """What every query term weighs, of the terms that occur in the query's workspace. The terms of a bounded
    query batch are broadcast, so that the counts, which grow with the corpus, stay where they are."""
    terms = asked.join(index.corpus, "workspace_id")
    return (
        (F.broadcast(terms) if small else terms)
        .join(index.counts.select("workspace_id", "run", "term", "df"), ["workspace_id", "run", "term"])
        .select("query_id", "workspace_id", "run", "term", "avgdl", "df", (F.col("qtf") * idf()).alias("weight"))
    )


def _part(tf: str, dl: str) -> Column:
    """What a term adds to a score for a weight of one: grows with tf, falls with dl."""
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col("avgdl")))


def _pairs(left: DataFrame, wanted: DataFrame, keys: list[str], by: str, load: str, small: bool) -> DataFrame:
    """`left` (postings or blocks) joined with the query terms on `keys`.

    A query batch of bounded size is broadcast and `left` stays where it is. For a larger one, a key
    with many pairs is cut into a grid: its rows by `by` and its queries, as `load` (rows of `left` a
    key has) times queries says, so that no task sees more than its share.
    """
    if small:
        return left.join(F.broadcast(wanted), keys)
    crowds = wanted.groupBy(*keys).agg(F.max(load).alias("rows"), F.count(F.lit(1)).alias("asked"))
    hot = materialize(
        crowds.where(F.col("rows") * F.col("asked") > PAIRS_PER_TASK).select(
            *keys,
            F.ceil(F.col("asked") / SIDE).cast("int").alias("cols"),
            F.ceil(F.col("rows") * F.least("asked", F.lit(SIDE)) / PAIRS_PER_TASK).cast("int").alias("lines"),
        ),
        "hot-terms",
    )
    hot = F.broadcast(hot) if fits_broadcast(hot) else hot
    lines, cols = F.coalesce("lines", F.lit(1)), F.coalesce("cols", F.lit(1))

    def all_of(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    placed = left.join(hot, keys, "left").withColumn("line", F.pmod(F.hash(by), lines)).withColumn("col", all_of(cols))
    tasks = wanted.join(hot, keys, "left").withColumn("col", F.pmod(F.hash("query_id"), cols)).withColumn("line", all_of(lines))
    return placed.drop("cols", "lines").join(tasks.drop("cols", "lines"), [*keys, "line", "col"])


def _sum(hits: DataFrame) -> DataFrame:
    # The block names the bucket: scores are summed where the postings lie.
    scores = hits.groupBy("workspace_id", "block", "query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") * _part("tf", "dl")), TIE_DIGITS).alias("score")
    )
    return scores.select("query_id", "chunk_id", "score")


def score(
    index: LexicalIndex,
    queries: DataFrame,
    tokenizer: Tokenizer = tokenize,
    small_queries: bool | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score) of every chunk that shares a term with the query."""
    asked = query_terms(queries, tokenizer)
    if small_queries is None:
        small_queries = fits_broadcast(asked, QUERY_TERMS)
    index = index.asked_by(queries)
    return _score(index, _wanted(index, asked, small_queries), small_queries)


def _score(index: LexicalIndex, wanted: DataFrame, small_queries: bool) -> DataFrame:
    return _sum(_pairs(index.postings, wanted, ["workspace_id", "run", "term"], "chunk_id", "df", small_queries))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.where(F.col("score") > 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def bounded_blocks(index: LexicalIndex, wanted: DataFrame, small_queries: bool) -> DataFrame:
    """(query_id, workspace_id, run, block, bound): no chunk of the block has a higher score for the query. A block
    without any of its terms has no row. A term that takes away (a negative weight) may be missing in a chunk."""
    blocks = index.blocks.withColumnRenamed("df", "chunks").drop("dl", "part")
    hits = _pairs(blocks, wanted, ["workspace_id", "run", "term"], "block", "df", small_queries)
    most = F.greatest("weight", F.lit(0.0)) * _part("max_tf", "min_dl")
    return hits.groupBy("query_id", "workspace_id", "run", "block").agg(F.sum(most).alias("bound"))


def _score_blocks(index: LexicalIndex, wanted: DataFrame, blocks: DataFrame, small_queries: bool) -> DataFrame:
    """Scores of all chunks of the given (query_id, workspace_id, block). With a bounded query batch, of which the
    blocks are few as well, postings stay where they are."""
    pairs = blocks.select(F.col("query_id").alias("_query"), F.col("workspace_id").alias("_space"), F.col("block").alias("_block"))
    same = F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("workspace_id") == F.col("_space"))
    if small_queries:
        hits = _pairs(index.postings, wanted, ["workspace_id", "run", "term"], "chunk_id", "df", True)
        return _sum(hits.join(F.broadcast(pairs), same & (F.col("block") == F.col("_block")), "left_semi"))
    tasks = wanted.drop("df").join(pairs, same).drop("_query", "_space").withColumnRenamed("_block", "block")
    return _sum(index.postings.drop("part").join(tasks, ["workspace_id", "run", "block", "term"]))


def pruned_scores(index: LexicalIndex, wanted: DataFrame, k: int, small_queries: bool) -> DataFrame:
    """Like `score`, but without chunks that cannot be among the best k.

    The k blocks of the highest bounds are scored first. Each holds a chunk with a term of the query, so
    the k-th best of their scores is one that the result reaches; blocks with a lower bound are left
    out. Where that leaves too many blocks in, as long queries do, everything is scored in one pass: that
    moves no postings, while pairs of a block and a query term are far more rows than the index has.
    """
    wanted = materialize(wanted, "query-weights")
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = bounded_blocks(index, wanted, small_queries).where(F.col("bound") > 0)
    bounds = materialize(bounds.withColumn("place", F.row_number().over(order)), "block-bounds")
    found = materialize(_score_blocks(index, wanted, bounds.where(F.col("place") <= k), small_queries), "first-scores")
    least = _best(found, k).where(F.col("place") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("least"))
    rest = (
        bounds.where(F.col("place") > k)
        .join(least, F.col("query_id").eqNullSafe(F.col("_query")), "left")
        # The bound is a sum in another order and scores are rounded.
        .where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least")))
    )
    rest = materialize(rest.select("query_id", "workspace_id", "block"), "blocks-left")
    few = fits_broadcast(rest, BLOCK_PAIRS) if small_queries else 2 * rest.count() <= bounds.count()
    if not few:
        return _score(index, wanted, small_queries)
    return found.unionByName(_score_blocks(index, wanted, rest, small_queries))


def top_k(
    index: LexicalIndex,
    queries: DataFrame,
    k: int,
    tokenizer: Tokenizer = tokenize,
    small_queries: bool | None = None,
    prune: bool | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, bm25_rank), ranks from 0, positive scores only.

    `queries` has query_id, workspace_id and query. With `prune`, by default from `PRUNE_FROM` pairs of a
    posting and a query on, blocks are bounded before they are scored; the result is the same.
    """
    asked, index = query_terms(queries, tokenizer), index.asked_by(queries)
    if small_queries is None or prune is None:
        rows, most = asked.join(index.corpus, "workspace_id", "left").agg(F.count(F.lit(1)), F.sum("n")).first()
        small_queries = rows <= QUERY_TERMS if small_queries is None else small_queries
        # No term lies in more chunks than its workspace has: most batches are known to be light without the counts.
        prune = (most or 0) >= PRUNE_FROM and _is_heavy(index, asked, small_queries) if prune is None else prune
    wanted = _wanted(index, asked, small_queries)
    scores = pruned_scores(index, wanted, k, small_queries) if prune else _score(index, wanted, small_queries)
    return _best(scores, k).select("query_id", "chunk_id", "score", (F.col("place") - 1).alias("bm25_rank"))


def _is_heavy(index: LexicalIndex, asked: DataFrame, small: bool) -> bool:
    return (_wanted(index, asked, small).agg(F.sum("df")).first()[0] or 0) >= PRUNE_FROM

"""File sources beside the triple parsers: archives, matrices, labels, manifests, tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import clamp01, node_type, normalize_entity, number
from ..schemas import OMICS_SPEC, TRIPLE_CSV
from . import archives


# --- text

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a plain, .gz or .zip text; of a zip the human member first, then a text member, then any."""
    if path.lower().endswith(".zip"):
        return archives.read(spark, path).select("value")
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def numbered(df: DataFrame) -> DataFrame:
    """Lines with their order ``n`` in the file."""
    return df.withColumn("n", F.monotonically_increasing_id())


def geo_series_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(value, n): the lines between the table's begin and end marks; none if there is no table."""
    text = numbered(read_lines(spark, path))
    marks = text.agg(F.min(F.when(F.startswith(F.lower("value"), F.lit("!series_matrix_table_begin")), F.col("n"))).alias("a"), F.min(F.when(F.startswith(F.lower("value"), F.lit("!series_matrix_table_end")), F.col("n"))).alias("b"))
    return text.crossJoin(marks).filter("n > a and n < b and trim(value) <> ''").select("value", "n")  # marks are one row


def tar_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(value): lines of the members of .tar or .tar.gz archives with that base name."""
    return archives.read(spark, path, name).select("value")


def sha256(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


# --- matrices, as long tables (entity, sample, value)

def matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A wide table whose first column names the rows: one long row per cell; text cells are null."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    first, *rest = wide.columns
    return wide.select(F.col(f"`{first}`").alias("entity"), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rest)).unpivot("entity", [f"`{c}`" for c in rest], "sample", "value")


def sample_ids(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    return spark.read.option("header", True).option("sep", sep).csv(path).columns[1:]


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(i, label): the first column of each line, numbered from 1."""
    from ..operators.graph import in_order

    own = read_lines(spark, path).filter(F.trim("value") != "").select(F.trim(F.split("value", r"[\t,]")[0]).alias("label"))
    return in_order(own).select(F.col("i").cast("int").alias("i"), "label")


def market_cells(spark: SparkSession, path: str, rows_path: str | None = None, columns_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored cells (entity, sample, value) of a .mtx file, all entities and all samples (i, label).

    Labels default to gene_0.., cell_0..; their number must fit.
    """
    text = numbered(read_lines(spark, path)).filter(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    cells = text.select("n", F.split(F.trim("value"), r"\s+").alias("f"))
    head = cells.orderBy("n").first()
    n_rows, n_columns = int(head["f"][0]), int(head["f"][1])
    values = cells.filter(F.col("n") > head["n"]).select(F.col("f")[0].cast("int").alias("r"), F.col("f")[1].cast("int").alias("c"), F.coalesce(F.get("f", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"))

    def named(p: str | None, n: int, prefix: str) -> DataFrame:
        if p is None:
            return spark.range(1, n + 1).select(F.col("id").cast("int").alias("i"), F.concat(F.lit(prefix), (F.col("id") - 1).cast("string")).alias("label"))
        own = labels(spark, p)
        if own.count() != n:
            raise ValueError(f"{p} has another number of labels than {n}")
        return own

    rows, columns = named(rows_path, n_rows, "gene_"), named(columns_path, n_columns, "cell_")
    stored = values.join(rows.select(F.col("i").alias("r"), F.col("label").alias("entity")), "r").join(columns.select(F.col("i").alias("c"), F.col("label").alias("sample")), "c")
    return stored.select("entity", "sample", "value"), rows, columns


def matrix_market(spark: SparkSession, path: str, rows_path: str | None = None, columns_path: str | None = None, dense: bool = True) -> DataFrame:
    """A .mtx file; ``dense`` gives absent cells as 0, and so as many rows as the matrix has cells. For the largest values
    of each sample ``build.top_of_sparse`` needs no such table."""
    stored, rows, columns = market_cells(spark, path, rows_path, columns_path)
    if not dense:
        return stored
    grid = rows.select(F.col("label").alias("entity")).crossJoin(columns.select(F.col("label").alias("sample")))
    return grid.join(stored, ["entity", "sample"], "left").select("entity", "sample", F.coalesce("value", F.lit(0.0)).alias("value"))


def perturbations(spark: SparkSession, path: str, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, perturbation): the last line of a cell wins; with ``cells`` (cell_id) the others are unknown."""
    own = spark.read.option("header", True).csv(path)
    if not {"cell_id", "perturbation"} <= set(own.columns):
        raise ValueError("a perturbation map needs cell_id and perturbation")
    last = own.withColumn("n", F.monotonically_increasing_id()).groupBy("cell_id").agg(F.max_by("perturbation", "n").alias("perturbation"))
    if cells is None:
        return last
    return cells.select("cell_id").distinct().join(last, "cell_id", "left").select("cell_id", F.coalesce("perturbation", F.lit("unknown")).alias("perturbation"))


def dataset(spark: SparkSession, matrix_path: str, matrix_format: str = "csv", genes_path: str | None = None, cells_path: str | None = None, perturbation_path: str | None = None, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(long expression with column cell, perturbations) of one dataset."""
    if matrix_format == "mtx":
        long = matrix_market(spark, matrix_path, genes_path, cells_path)
    elif matrix_format in ("csv", "tsv"):
        long = matrix(spark, matrix_path, "\t" if matrix_format == "tsv" else delimiter)
    else:
        raise ValueError(f"no matrix format {matrix_format}")
    long = long.withColumnRenamed("sample", "cell")
    cells = long.select(F.col("cell").alias("cell_id"))
    known = perturbations(spark, perturbation_path, cells) if perturbation_path else cells.distinct().withColumn("perturbation", F.lit("unknown"))
    return long, known


def gene_effects(spark: SparkSession, path: str) -> DataFrame:
    """(entity, sample, value) of a gene-effect table whichever way round it lies."""
    wide = spark.read.option("header", True).csv(path)
    n = wide.count()
    long = matrix(spark, path)
    if n < len(wide.columns) - 1 and n < 5000:
        return long.select(F.col("sample").alias("entity"), F.col("entity").alias("sample"), "value")
    return long


# --- manifests and small tables

def omics_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Omics specs with their defaults."""
    text = spark.read.option("wholetext", True).text(path).select(F.from_json("value", f"datasets array<struct<{_fields(OMICS_SPEC)}>>").alias("d"))
    own = text.select(F.explode("d.datasets").alias("s")).select("s.*")
    plain = {"matrix_format": "csv", "delimiter": ",", "sample_id_column": "sample_id", "cell_line_column": "cell_line", "condition_column": "condition", "version": "v1"}
    fill = {c: F.coalesce(c, F.lit(v)) for c, v in plain.items()} | {"top_k": F.coalesce("top_k", F.lit(0)), "min_value": F.coalesce("min_value", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.7)), "source": F.coalesce("source", "name")}
    return own.withColumns(fill)


def _fields(ddl: str) -> str:
    return ",".join(":".join(x.split()) for x in ddl.split(","))


def sample_metadata(spark: SparkSession, path: str, id_column: str = "sample_id", cell_line: str = "cell_line", condition: str = "condition") -> DataFrame:
    """(sample, cell_line, condition), the last line of a sample; empty without the id column."""
    own = spark.read.option("header", True).csv(path)
    if id_column not in own.columns:
        return spark.createDataFrame([], "sample string, cell_line string, condition string")
    some = lambda c: F.col(f"`{c}`") if c in own.columns else F.lit(None).cast("string")
    rows = own.select(F.col(id_column).alias("sample"), F.struct(some(cell_line).alias("cell_line"), some(condition).alias("condition")).alias("m"), F.monotonically_increasing_id().alias("n"))
    return rows.groupBy("sample").agg(F.max_by("m", "n").alias("m")).select("sample", "m.*")


def mirna_targets(spark: SparkSession, path: str) -> DataFrame:
    """(mirna, gene), by column names or else the first two columns."""
    own = spark.read.option("header", True).csv(path)
    low = {c.lower(): c for c in own.columns}
    a, b = low.get("mirna", own.columns[0]), low.get("target", low.get("gene", own.columns[1] if len(own.columns) > 1 else own.columns[0]))
    return own.select(F.trim(F.col(f"`{a}`")).alias("mirna"), F.trim(F.col(f"`{b}`")).alias("gene")).filter("mirna <> '' and gene <> ''")


def seed_genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene), upper case and distinct; empty without that column."""
    own = spark.read.option("header", True).csv(path)
    if "gene" not in own.columns:
        return spark.createDataFrame([], "gene string")
    return own.select(F.upper(normalize_entity(F.col("gene"))).alias("gene")).filter("gene <> ''").distinct()


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """(protein, log2_fc, source): the largest change of each protein, the first of equals; columns by alias, bad numbers 0."""
    own = spark.read.option("header", True).option("escape", '"').csv(path)
    pick = lambda *names: next((F.col(f"`{c}`") for n in names for c in own.columns if c.lower() == n), None)
    name, change, source = pick("protein", "protein_symbol", "gene", "symbol", "target"), pick("log2_fc", "log2fc", "fold_change_log2", "delta"), pick("source")
    if name is None or change is None:
        return spark.createDataFrame([], "protein string, log2_fc double, source string")
    rows = own.select(F.upper(F.trim(name)).alias("protein"), number(change, 0.0).alias("log2_fc"), (F.lit("") if source is None else F.coalesce(source, F.lit(""))).alias("source"), F.monotonically_increasing_id().alias("n")).filter("protein <> ''")
    return best_calibration(rows)


def best_calibration(rows: DataFrame) -> DataFrame:
    return rows.groupBy("protein").agg(F.max_by(F.struct("log2_fc", "source"), F.struct(F.abs("log2_fc").alias("a"), (-F.col("n")).alias("o"))).alias("b")).select("protein", "b.log2_fc", "b.source")


def median_calibration(rows: DataFrame) -> DataFrame:
    """(protein, log2_fc, source): the median change and the first source, from rows with an order n."""
    return rows.groupBy("protein").agg(F.median("log2_fc").alias("log2_fc"), F.min_by("source", "n").alias("source"))


def triples_csv(spark: SparkSession, path: str, weight: float = 1.0, confidence: float = 0.5) -> DataFrame:
    """A triples table written by ``sinks.write_triples``; numbers are clamped, absent ones get the defaults."""
    own = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(TRIPLE_CSV).csv(path)
    return own.filter("head <> '' and tail <> ''").withColumns({"weight": clamp01(F.coalesce("weight", F.lit(weight))), "confidence": clamp01(F.coalesce("confidence", F.lit(confidence))), "head_type": node_type(F.col("head")), "tail_type": node_type(F.col("tail"))})


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content, metadata) of a JSON array of documents, numbered in order."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.posexplode(F.from_json("value", "array<struct<content:string,page_content:string,metadata:map<string,string>>>")).alias("doc_id", "d"))
    return rows.select(F.col("doc_id").cast("long"), F.coalesce("d.content", "d.page_content", F.lit("")).alias("content"), F.coalesce("d.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def manifest(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def choose_parser(entry: dict) -> str | None:
    """The registry's name for a manifest entry: its own ``parser``, else by its name or a prefix of it."""
    from .parsers import REGISTRY

    name = str(entry.get("parser") or entry.get("name") or "").lower()
    if name in REGISTRY:
        return name
    heads = {"kegg": "kegg_gene_pathway", "wikipathways": "wikipathways_query", "biogrid": "biogrid_tab3", "signor": "signor", "omnipath": "omnipath", "encode": "encode_eclip", "npinter": "npinter", "pathway_commons": "pathway_commons_sif", "ncbi": "ncbi_gene_info", "ensembl": "ensembl_gtf"}
    return next((p for h, p in heads.items() if name.startswith(h)), None)


def source_triples(spark: SparkSession, entries: list[dict], min_score: int = 700, max_rows: int | None = None, strict: bool = False) -> Iterator[tuple[str, DataFrame]]:
    """(name, triples) of each usable entry, one at a time; unknown parsers are passed over, failing sources too unless ``strict``.

    A source is read and written to the scratch folder before the next one begins, so that one with a broken file fails
    by itself and not the job that reads them all.
    """
    from ..operators.graph import cut
    from .parsers import REGISTRY

    for e in entries:
        parser = choose_parser(e)
        if e.get("status") != "ok" or not e.get("path") or parser is None:
            continue
        more = {"min_score": min_score} if parser == "string_ppi" else {"query_gene": e.get("query_gene") or ""} if parser in ("kegg_gene_pathway", "wikipathways_query") else {}
        try:
            df = REGISTRY[parser](spark, e["path"], e.get("source") or e.get("name"), e.get("version") or "v1", max_rows=max_rows, **more)
            df = cut(df)
        except Exception as x:
            if strict:
                raise
            print(f"source {e.get('name')} left out: {x}")
            continue
        yield e.get("name", parser), df


def manifest_triples(spark: SparkSession, entries: list[dict], **options) -> DataFrame:
    """All sources' triples, the first of equal keys by source order."""
    from ..operators.build import dedup_triples

    parts = [df.withColumn("_source_no", F.lit(i)).withColumn("_row", F.monotonically_increasing_id()) for i, (_, df) in enumerate(source_triples(spark, entries, **options))]
    if not parts:
        from ..schemas import TRIPLE

        return spark.createDataFrame([], TRIPLE)
    return dedup_triples(reduce(DataFrame.unionByName, parts), ("_source_no", "_row")).drop("_source_no", "_row")


def kegg_ids(lines_: DataFrame, symbol: str) -> DataFrame:
    """(id): hsa ids whose description has the symbol as a token, distinct."""
    token = rf"(?i)(^|[^A-Za-z0-9]){re.escape(symbol)}([^A-Za-z0-9]|$)"
    f = F.split("value", "\t")
    return lines_.select(f[0].alias("id"), F.coalesce(F.get(f, F.lit(1)), F.lit("")).alias("text")).filter(F.startswith("id", F.lit("hsa:")) & F.col("text").rlike(token)).select("id").distinct()


def with_catalog(results: DataFrame, catalog: DataFrame, order: str) -> DataFrame:
    """Manifest rows with what the catalog knows of their name, the first entry by ``order``; unknown names stay."""
    rest = [c for c in catalog.columns if c != "name"]
    first = catalog.groupBy("name").agg(F.min_by(F.struct(*rest), order).alias("c")).select("name", *(F.col(f"c.{c}").alias(c) for c in rest))
    return results.join(first, "name", "left")


def datasets(entries: DataFrame) -> DataFrame:
    """(source, version, files, categories): manifest entries by data set."""
    return entries.groupBy("source", "version").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("category")).alias("categories"))


#: Folders that a data set's samples are dealt to; a chunk is a run of them.
SLOTS = 64


def omics_chunks(long: DataFrame, spec: DataFrame, chunk_rows: int = 0, slots: int = SLOTS, **options) -> Iterator[DataFrame]:
    """Omics triples spec by spec, in parts of about ``chunk_rows`` matrix cells (0: a spec at a time).

    A part holds whole samples, so that each sample's top genes are chosen from all of its cells. The input is read once:
    it is written by data set and slot, a hash of the sample, and a part reads the folders of its slots alone. A slot is
    never cut, so a part has the cells of one slot at least.
    """
    from ..operators.build import omics_triples
    from ..operators.graph import scratch

    spark = long.sparkSession
    path = scratch(spark, "chunks")
    known = long.join(F.broadcast(spec.select("name").distinct()), "name", "left_semi")  # a row a data set
    dealt = known.withColumn("slot", F.pmod(F.xxhash64("sample"), F.lit(slots)).cast("int"))
    dealt.repartition("name", "slot").write.partitionBy("name", "slot").parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    cells = {(r["name"], r["slot"]): r["n"] for r in written.groupBy("name", "slot").agg(F.count("*").alias("n")).collect()}  # a row a folder
    for name in sorted({n for n, _ in cells}):
        parts: list[list[int]] = [[]]
        size = 0
        for slot in sorted(s for n, s in cells if n == name):
            if parts[-1] and chunk_rows > 0 and size + cells[name, slot] > chunk_rows:
                parts.append([])
                size = 0
            parts[-1].append(slot)
            size += cells[name, slot]
        for part in parts:
            own = written.filter((F.col("name") == name) & F.col("slot").between(part[0], part[-1])).drop("slot")
            yield omics_triples(own, spec.filter(F.col("name") == name), **options)

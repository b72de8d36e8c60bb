"""CSV, JSON, XML and four-file sources, all as text columns ready for mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.case import Case
from ledgerscope.operators import case_files, records
from ledgerscope.functions.ordered import row_numbers
from ledgerscope.schema import REQUIRED
from ledgerscope.session import materialize

FORMATS = {
    "csv": "csv", "tsv": "csv", "txt": "csv",
    "json": "json", "ndjson": "json", "jsonl": "json",
    "xml": "xml",
}


Paths = str | list[str]
# Where a row was read, beside its record; dropped unless asked for.
SOURCE = "_source_file"
# Place of a row in its scan, kept beside it.
PLACE = "_scan_place"


def _lines(spark: SparkSession, path: Paths) -> DataFrame:
    """(line, file, block, at) of every line that is not blank; (block, at) is its order within the file."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    rows = text.select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return rows.where("trim(line) <> ''").withColumn("at", F.monotonically_increasing_id())


def sniff_delimiter(lines: list[str]) -> str:
    """The candidate found most evenly, then most often, over the lines; comma when none is."""
    best, score = ",", (0.0, 0)
    for mark in ",\t;|":
        counts = [line.count(mark) for line in lines]
        if counts and counts[0]:
            even = sum(c == counts[0] for c in counts) / len(counts)
            if (even, counts[0]) > score:
                best, score = mark, (even, counts[0])
    return best


def _numbered(df: DataFrame, prefix: str, place: str | None = None) -> DataFrame:
    """Fills blank record ids with the row's ordinal in scan order.

    The partition and the place within it come from the scan itself, or from ``place`` where an earlier step kept them; only
    one offset per scan partition is summed, so no row leaves its task.
    """
    tagged = df.withColumn("_id", F.monotonically_increasing_id()) if place is None else df.withColumnRenamed(place, "_id")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(part.alias("_p")).agg((F.max(place) + 1).alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    ordinal = F.col("_offset") + place + 1
    # One row per scan partition: small enough to broadcast by construction.
    joined = tagged.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    made = F.format_string(f"{prefix}-row-%06d", ordinal)
    if "record_id" in df.columns:
        given = F.when(F.trim(F.col("record_id").cast("string")) != "", F.col("record_id").cast("string"))
        made = F.coalesce(given, made)
    return joined.withColumn("record_id", made).drop("_id", "_p", "_offset")


def read_csv(spark: SparkSession, path: Paths, source: bool = False) -> DataFrame:
    """Files with a header each. Delimiter and columns come from every file's own header; files of one header are one
    scan. The names of the files and their headers come to the driver, no other line."""
    heads = _lines(spark, path).groupBy("file").agg(F.min_by("line", F.struct("block", "at")).alias("head"))
    layouts: dict[str, list[str]] = {}
    for row in heads.orderBy("file").collect():
        layouts.setdefault(row["head"].strip(), []).append(row["file"])
    out = None
    for head, files in sorted(layouts.items()):
        where = path if len(layouts) == 1 else files
        reader = spark.read.option("recursiveFileLookup", True)
        raw = reader.csv(where, header=True, sep=sniff_delimiter([head]), encoding="UTF-8", escape='"')
        # An empty cell of a CSV is present but blank, unlike a column the file does not have.
        named = raw.select(
            *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("\ufeff").strip()) for c in raw.columns],
            F.col("_metadata.file_path").alias(SOURCE),
        )
        if len(layouts) > 1:
            named = records.map_columns(named)
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no lines found in {path}")
    return _numbered(out if source else out.drop(SOURCE), "csv")


def _columns_of(objects: DataFrame) -> DataFrame:
    """The keys of JSON object texts as text columns; nested values stay JSON text, absent keys are null.

    Only the distinct key names come to the driver. Keys that differ by case or by blanks around them are one column.
    """
    held = objects.withColumn("_map", F.from_json("_object", "map<string,string>"))
    rest = [c for c in objects.columns if c != "_object"]
    names = sorted(r[0] for r in held.select(F.explode(F.map_keys("_map"))).distinct().collect())
    same: dict[str, list[str]] = {}
    for name in names:
        same.setdefault(name.strip().lower(), []).append(name)
    columns = [F.coalesce(*[F.col("_map")[k] for k in keys]).alias(keys[0].strip()) for keys in same.values()]
    return held.select(*columns, *rest)


def _one_value(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null for any other text.

    The parser passes over what follows the first value. So the text is read as the first of two items of a list, the second
    a number made from the text: a text that ends the list early, or holds more than one item, loses that number.
    """
    mark = F.xxhash64(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    return F.transform(F.array(listed), lambda both: F.when(
        F.try_variant_get(both, "$[1]", "bigint") == mark, F.try_variant_get(both, "$[0]", "variant")
    ))[0]


def _once(value: Column) -> Column:
    """The same value, which filters above it do not make a second time: a row's number is not deterministic."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def read_json(spark: SparkSession, path: Paths, source: bool = False) -> DataFrame:
    """One object per line, or one document a file: an array, a records/data wrapper or a single object.

    Every file is judged by its own lines. A file in which most lines are complete objects is read by line and only
    the lines that are not objects are dropped. Any other file that opens like a document is parsed whole; a file whose
    whole text is not one value is read by line after all. Items of a document that are not objects are dropped singly. A wrapper on a
    single line is opened like a document.
    """
    lines = _lines(spark, path).withColumn("line", F.trim("line"))
    # A complete object by itself.
    shut = F.col("line").startswith("{") & F.col("line").endswith("}")
    filled = lines.withColumn("doc", _once(F.when(shut, _one_value(F.col("line")))))
    place = F.struct("block", "at")
    shapes = filled.select("file", "block", "at", F.substring("line", 1, 1).alias("opens"), F.col("doc").isNotNull().alias("complete")).groupBy("file").agg(
        F.min_by("opens", place).alias("opens"),
        (F.count_if("complete") * 2 > F.count(F.lit(1))).alias("by_line"),
    )
    # Names of the files that open like a document; their rows stay where they are.
    documents = [r[0] for r in shapes.where("not by_line and opens in ('[', '{')").select("file").collect()]
    whole = None
    if documents:
        raw = spark.read.text(documents, wholetext=True).select(
            F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file")
        )
        # Parsed once: the files read as documents are known before their rows are taken apart.
        whole = raw.select(_once(_one_value(F.trim("value"))).alias("doc"), "file").where("doc is not null")
        whole = materialize(whole.select(F.to_json("doc").alias("text"), "file"), "documents")
        parsed = whole.select("file").distinct()
        filled = filled.join(parsed, "file", "left_anti")
        whole = whole.select(_once(F.try_parse_json("text")).alias("doc"), "file")
    single = filled.where("doc is not null").select("doc", "file")
    docs = single if whole is None else single.unionByName(whole)

    def many(at: str) -> Column:
        return F.try_variant_get("doc", at, "array<variant>")

    items = F.coalesce(many("$.records"), many("$.data"), many("$"), F.array("doc"))
    each = docs.select(_once(items).alias("items"), F.col("file").alias(SOURCE)).select(F.explode("items").alias("item"), SOURCE)
    objects = each.select(F.to_json("item").alias("_object"), SOURCE).where(F.col("_object").startswith("{"))
    # Written once: the names of the keys, the numbers of rows and the records themselves are three passes over it.
    kept = objects.withColumn(PLACE, F.monotonically_increasing_id())
    held = materialize(kept if source else kept.drop(SOURCE), "objects")
    return _numbered(_columns_of(held), "json", PLACE)


# Roots whose children are the records. Any other root is itself a record.
XML_ROOTS = ("records", "transactions", "observations", "dataset", "root")


def record_tags(spark: SparkSession, path: Paths) -> list[str]:
    """Tags of the elements that are records: the root's children, or the root itself.

    The text is cut after every "</", so a piece starts with the name of a closed element and what opens next in it is
    its sibling. The root and its first child stand in the piece ahead of the first cut. Siblings of the first child,
    and theirs, are the root's children. Only distinct pairs of tag names come to the driver.
    """
    pieces = spark.read.text(path, lineSep="</").select(
        F.regexp_replace("value", r"(?s)<[?!].*?>", "").alias("piece")
    )
    tag = r"<([A-Za-z_][\w:.-]*)[^<>]*?(/?)>"
    opened = F.transform(F.regexp_extract_all("piece", F.lit(r"<[A-Za-z_][^<>]*>"), F.lit(0)), lambda t: F.struct(
        F.regexp_extract(t, tag, 1).alias("name"), (F.regexp_extract(t, tag, 2) == "/").alias("empty")
    ))
    closed = F.regexp_extract("piece", r"^([A-Za-z_][\w:.-]*)\s*>", 1)
    found = pieces.select(closed.alias("closed"), opened.alias("opened"))
    # Up to the first element that stays open, everything that opens is a sibling.
    run = F.aggregate(
        "opened",
        F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("names")),
        lambda s, t: F.when(s["done"], s).otherwise(
            F.struct((~t["empty"]).alias("done"), F.concat(s["names"], F.array(t["name"])).alias("names"))
        ),
    )["names"]
    pairs = found.where("closed <> ''").select("closed", F.explode(run).alias("next")).distinct().collect()
    inner = F.aggregate(
        F.slice("opened", F.lit(2), F.size("opened")),
        F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("names")),
        lambda s, t: F.when(s["done"], s).otherwise(
            F.struct((~t["empty"]).alias("done"), F.concat(s["names"], F.array(t["name"])).alias("names"))
        ),
    )["names"]
    heads = (
        found.where("closed = '' and size(opened) > 0")
        .select(F.get("opened", F.lit(0))["name"].alias("root"), inner.alias("children"))
        .distinct().collect()
    )
    tags: set[str] = set()
    for root, children in heads:
        if root.lower() not in XML_ROOTS:
            tags.add(root)
            continue
        reached = set(children)
        while more := {b for a, b in pairs if a in reached} - reached:
            reached |= more
        tags |= reached
    return sorted(tags)


def read_xml(spark: SparkSession, path: Paths, source: bool = False) -> DataFrame:
    """The records of every tag, one scan a tag; nested items become lists written as JSON text."""
    out = None
    for tag in record_tags(spark, path):
        part = spark.read.option("rowTag", tag).option("inferSchema", False).xml(path)
        flat = part.select(
            *([F.col("_metadata.file_path").alias(SOURCE)] if source else []),
            *[
                F.to_json(records.as_list(f)).alias(f.name)
                if isinstance(f.dataType, (T.ArrayType, T.StructType))
                else F.col(f"`{f.name}`").cast("string").alias(f.name)
                for f in part.schema
            ]
        )
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no records found in {path}")
    return _numbered(out, "xml")


READERS = {"csv": read_csv, "json": read_json, "xml": read_xml}


def read_records(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Mapped records of one file or folder; the format comes from the extension unless named."""
    ext = (fmt or path.rsplit(".", 1)[-1]).lower().lstrip(".")
    if ext not in FORMATS:
        raise ValueError(f"unsupported format: {ext}")
    return records.map_columns(READERS[FORMATS[ext]](spark, path))


def raw_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a raw folder; the listing comes from Spark's own file index, not from file contents."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return sorted(r[0] for r in listed.select("path").collect())


def read_folder(spark: SparkSession, folder: str, kind: str = "auto") -> DataFrame:
    """Every supported file of a folder, validated; the files of a format are read together, with their paths."""
    files: dict[str, list[str]] = {}
    for path in raw_files(spark, folder):
        fmt = FORMATS.get(path.rsplit(".", 1)[-1].lower())
        if fmt:
            files.setdefault(fmt, []).append(path)
    out = None
    for fmt, paths in sorted(files.items()):
        mapped = records.map_columns(READERS[fmt](spark, paths, source=True)).withColumnRenamed(SOURCE, "source")
        checked = records.validate(mapped, kind)
        keep = [c for c in checked.columns if c in {*records.ALIASES, "record_id", "issues", "is_valid", "source"}]
        part = checked.select(*keep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no readable files in {folder}")
    return out


def four_files(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The raw case tables found in a folder, None where a file is missing."""
    names = {p.rsplit("/", 1)[-1]: p for p in raw_files(spark, folder)}
    return {
        n: spark.read.csv(names[f"{n}.csv"], header=True) if f"{n}.csv" in names else None for n in REQUIRED
    }


def is_four_file_case(spark: SparkSession, folder: str) -> bool:
    return all(t is not None for t in four_files(spark, folder).values())


def synthesize_ids(df: DataFrame, prefix: str, order: list[str], rows: int | None = None) -> DataFrame:
    """record_id from the position in a stable order, for tables that carry none."""
    placed = row_numbers(df, [], order, "_at", rows)
    return placed.withColumn("record_id", F.format_string(f"{prefix}-%06d", "_at")).drop("_at")


def _with_ids(df: DataFrame, prefix: str, rows: int | None) -> DataFrame:
    """Chronological record ids; rows equal in every column are interchangeable."""
    keyed = df.withColumns({"_t": F.coalesce("timestamp_epoch", F.lit(0)), "_key": F.to_json(F.struct(*df.columns))})
    return synthesize_ids(keyed, prefix, ["_t", "_key"], rows).drop("_t", "_key")


def read_four_file_case(spark: SparkSession, folder: str) -> Case:
    raw = four_files(spark, folder)
    lost = [n for n, t in raw.items() if t is None]
    if lost:
        raise ValueError(f"not a four-file case, missing {lost}")
    txs = case_files.canonical_transactions(raw["transactions"])
    net = case_files.canonical_network(raw["network"])
    n_tx, n_net = txs.count(), net.count()
    inputs = case_files.canonical_inputs(raw["inputs"])
    outputs = case_files.canonical_outputs(raw["outputs"])
    return Case(
        _with_ids(txs, "tx-rec", n_tx),
        inputs,
        outputs,
        _with_ids(net, "net-rec", n_net),
        (n_tx, inputs.count(), outputs.count(), n_net),
    )

"""Readers that turn text into records.

A record is (rec bigint, kinds map, texts map): the JSON kind and the text of each
top-level field. Field names stay map keys, since logs hold names that differ only
in case. rec orders records as they stand in their files: it is the number that
monotonically_increasing_id() gives a line, or a file and its element (element_of).

Maps are made in a generator (once): what stands above reads them as columns, where
a projection would be merged into every expression and filter that uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Room for the files of a partition, and for the elements of one, within 33 bits of a record's number.
FILES, ELEMENTS = 1 << 8, 1 << 25
_PART = 33


def field_maps(json: Column) -> tuple[Column, Column]:
    """(kinds, texts) of a JSON object's fields; null for other text."""
    texts = F.from_json(json, "map<string,string>")
    kinds = F.transform_values(F.from_json(json, "map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    return kinds, texts


def element_of(rec: Column, at: Column) -> Column:
    """The number of an element of a whole file: partition, file in it, place. More than 63 - 33 bits of partitions never are."""
    file = rec.bitwiseAND((1 << _PART) - 1)
    number = F.shiftleft(F.shiftright(rec, _PART), _PART) + file * ELEMENTS + at
    return F.when((file < FILES) & (at < ELEMENTS), number).otherwise(F.raise_error(F.concat(F.lit("no number for element "), at.cast("string"), F.lit(" of file "), file.cast("string"), F.lit(" of a partition"))).cast("bigint"))


def once(rows: DataFrame, keep: list[str | Column], made: dict[str, Column], where: str) -> DataFrame:
    """keep, and the made columns where those named in `where` are not null, each evaluated once a row."""
    row = F.array(F.struct(*(v.alias(k) for k, v in made.items())))
    return rows.select(*keep, F.inline(F.filter(row, lambda r: _holds(r, where))))


def _holds(row: Column, names: str) -> Column:
    """All the named fields, separated by blanks, are there."""
    out = None
    for name in names.split():
        own = row[name].isNotNull()
        out = own if out is None else out & own
    return out


def text_of(name: str, record: str = "") -> Column:
    """The field where it is a JSON string that is not empty, else null."""
    return F.when(F.try_element_at(F.col(f"{record}kinds"), F.lit(name)) == "STRING", F.nullif(F.try_element_at(F.col(f"{record}texts"), F.lit(name)), F.lit("")))


def _numeric(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")


def whole_of(name: str) -> Column:
    """The field's text where it is a JSON integer."""
    text = F.try_element_at(F.col("texts"), F.lit(name))
    return F.when(_numeric(F.try_element_at(F.col("kinds"), F.lit(name))) & text.rlike(r"^-?\d+$"), text)


def unsigned_of(name: str) -> Column:
    return F.when(~whole_of(name).startswith("-"), whole_of(name))


def either_of(name: str) -> Column:
    """An unsigned integer's or any string's text, the empty one too."""
    return F.coalesce(unsigned_of(name), F.when(F.try_element_at(F.col("kinds"), F.lit(name)) == "STRING", F.try_element_at(F.col("texts"), F.lit(name))))


def present(name: str) -> Column:
    return F.coalesce(F.map_contains_key("kinds", name), F.lit(False))


def scalar_fields(kinds: Column, texts: Column) -> Column:
    """Entries (key, value) in byte order of keys: strings that are not empty, and numbers as written."""
    kept = F.map_filter(texts, lambda k, v: F.when(F.element_at(kinds, k) == "STRING", v != "").otherwise(_numeric(F.element_at(kinds, k))))
    return F.array_sort(F.map_entries(kept))


def spread(lines: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where there are fewer splits than these: parsing costs more than moving them."""
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(cores) if lines.rdd.getNumPartitions() < cores else lines


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(rec, value) of every line."""
    return spread(spark.read.text(path).select(F.monotonically_increasing_id().alias("rec"), "value"))


def densely_numbered(lines: DataFrame) -> DataFrame:
    """(rec, value) of lines numbered 0, 1, ... without gaps: one pass counts the lines of each split."""
    own = lines.select(F.spark_partition_id().alias("split"), F.monotonically_increasing_id().bitwiseAND((1 << _PART) - 1).alias("k"), "value")
    before, bases = 0, []
    for split, n in sorted(tuple(r) for r in own.groupBy("split").count().collect()):  # a row for each split
        bases.append((split, before))
        before += n
    table = lines.sparkSession.createDataFrame(bases, "split int, base bigint")
    return own.join(F.broadcast(table), "split").select((F.col("base") + F.col("k")).alias("rec"), "value")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """(rec, value) of the lines of a text in hand."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "rec bigint, value string")


def ndjson(lines: DataFrame) -> DataFrame:
    """Records of one JSON object a line; blank and broken lines go."""
    kinds, texts = field_maps(F.col("value"))
    return once(lines.where(F.trim("value").startswith("{")), ["rec", F.col("value").alias("raw")], {"kinds": kinds, "texts": texts}, "kinds texts")


def json_array(whole: DataFrame) -> DataFrame:
    """Records of texts that are one JSON array; other texts give none."""
    items = F.from_json(F.col("value"), "array<string>")
    rows = whole.where(F.ltrim("value").startswith("[")).select("rec", F.posexplode(items).alias("at", "raw"))
    kinds, texts = field_maps(F.col("raw"))
    return once(rows, [element_of(F.col("rec"), F.col("at")).alias("rec"), "raw"], {"kinds": kinds, "texts": texts}, "kinds texts")


def read_json(spark: SparkSession, path: str | list[str], array: bool) -> DataFrame:
    """A JSON array per file, or one object per line."""
    if array:
        whole = spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("rec"), "value")
        return json_array(whole)
    return ndjson(read_lines(spark, path))


def _strings(texts: Column) -> tuple[Column, Column]:
    return F.transform_values(texts, lambda k, v: F.lit("STRING")), texts


def csv(lines: DataFrame, header: str | None = None) -> DataFrame:
    """Records of comma-separated lines with quotes and doubled quotes.

    Without `header` the first line by rec is the header. Values are trimmed, empty
    ones dropped, missing columns absent, extra ones left aside, blank lines skipped.
    """
    full = lines.where(F.trim("value") != "")
    if header is None:
        first = full.orderBy("rec").first()
        if first is None:
            return lines.select("rec", F.lit("").alias("raw"), F.create_map().cast("map<string,string>").alias("kinds"), F.create_map().cast("map<string,string>").alias("texts")).limit(0)
        header = first.value
        full = full.where(F.col("rec") != first.rec)
    import csv as standard

    names = [x.strip() for x in next(standard.reader([header]))]
    wanted = {x: i for i, x in reversed(list(enumerate(names))) if x}
    shape = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("value", shape, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    rows = full.select("rec", "value", cells.alias("cells"))
    pairs = F.array(*(F.struct(F.lit(x).alias("key"), F.trim(F.col(f"cells.c{i}")).alias("value")) for x, i in wanted.items()))
    texts = F.map_from_entries(F.filter(pairs, lambda p: p["value"] != ""))
    rows = once(rows, ["rec", F.col("value").alias("raw")], {"texts": texts}, "texts")
    return rows.withColumn("kinds", _strings(F.col("texts"))[0]).select("rec", "raw", "kinds", "texts")


# A key, and its value with the tokens after it that hold no `=`.
_CEF_PAIR = r"(?:^|\s)([^\s=]*+)=(\S*+(?:\s++[^\s=]++(?=\s|$))*+)"


def cef(value: Column) -> Column:
    """Fields of a `CEF:` line as a map, or null.

    Seven pipes end the header; extension tokens without `=` belong to the value before them.
    """
    parts = F.split(value, r"\|", 8)
    rest, pattern = F.try_element_at(parts, F.lit(8)), F.lit(_CEF_PAIR)
    values = F.transform(F.regexp_extract_all(rest, pattern, F.lit(2)), lambda v: F.regexp_replace(F.trim(v), r"\s+", " "))
    return F.when(F.trim(value).startswith("CEF:") & (F.size(parts) == 8), _last_wins(F.regexp_extract_all(rest, pattern, F.lit(1)), values))


def leef(value: Column) -> Column:
    """Fields of a `LEEF:` line (five pipes, then tab-separated pairs) as a map, or null."""
    parts = F.split(value, r"\|", 6)
    pairs = F.filter(F.split(F.try_element_at(parts, F.lit(6)), "\t"), lambda t: F.contains(t, F.lit("=")))
    keys = F.transform(pairs, lambda t: F.trim(F.substring_index(t, "=", 1)))
    values = F.transform(pairs, lambda t: F.trim(F.substring(t, F.instr(t, "=") + 1, F.length(t))))
    return F.when(F.trim(value).startswith("LEEF:") & (F.size(parts) == 6), _last_wins(keys, values))


def _last_wins(keys: Column, values: Column) -> Column:
    """A map in which a later value replaces an earlier one of its key."""
    back, last = F.reverse(keys), F.reverse(values)
    own = F.array_distinct(keys)
    return F.when(F.size(own) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(own, F.transform(own, lambda k: F.element_at(last, F.array_position(back, k).cast("int")))))


def mixed_lines(lines: DataFrame) -> DataFrame:
    """Records of lines that are JSON objects, CEF or LEEF, each by itself; others go."""
    trimmed = F.trim("value")
    is_json, is_cef, is_leef = (trimmed.startswith(x) for x in ("{", "CEF:", "LEEF:"))
    kinds, texts = field_maps(F.when(is_json, F.col("value")))
    other = F.when(is_cef, cef(trimmed)).when(is_leef, leef(trimmed))
    kept = lines.where(is_json | is_cef | is_leef)
    rows = kept.select("rec", F.col("value").alias("raw"), F.inline(F.array(F.struct(kinds.alias("k"), texts.alias("t"), other.alias("o")))))
    return rows.where("(k is not null and t is not null) or o is not null").select("rec", "raw", F.coalesce("k", _strings(F.col("o"))[0]).alias("kinds"), F.coalesce("t", "o").alias("texts"))

"""Readers: annotation JSON, object records, LabelMe files, reports, runs, logs, images and case lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.parsing import SLOTS, stem, stratum
from scorelake.sources import json_ranges

SECTIONS = {f"categories_{level}": "id int, name string" for level in (1, 2, 3)} | {
    "images": "id int, file_name string",
    "annotations": "image_id int, category_id_1 int, category_id_2 int, category_id_3 int, bbox array<double>",
}
OBJECTS = "`External ID` string, Label struct<objects:array<struct<title:string>>>"
SHAPES = "shapes array<struct<label:string>>"
FINDINGS = "map<string,array<string>>"
RESULT = f"struct<case_id:string,file_name:string,response:string,confidence:string,seconds:double,error:string,predicted_teeth:array<int>,ground_truth_teeth:array<int>,predicted_findings:{FINDINGS},ground_truth_findings:{FINDINGS}>"
RUN = f"timestamp string, tag string, strategy string, dataset string, run_config struct<dataset:string,strategy:string>, diseases array<string>, fdi_teeth array<int>, case_ids array<string>, models map<string,struct<model_key:string,display_name:string,repo_id:string,error:string,results:array<{RESULT}>>>"
TEXT_RUN = "models map<string,struct<display_name:string,summary:map<string,double>,cases:array<struct<case_id:string,stratum:string,response:string,seconds:double,error:string,metrics:map<string,double>>>>>"

# Label words and their conditions; words without one are dropped.
LABEL_WORDS = {
    "gömülü": "Impacted",
    "gomulu": "Impacted",
    "çürük": "Caries",
    "curuk": "Caries",
    "küretaj": "Caries",
    "kuretaj": "Caries",
    "lezyon": "Periapical Lesion",
    "kanal": "Periapical Lesion",
}
IMAGE_TYPES = (".JPG", ".jpg", ".jpeg", ".JPEG", ".png", ".PNG")


def annotation_file(spark: SparkSession, path: str, split: str) -> dict[str, DataFrame]:
    """images (image_id, case_id), boxes (a row an annotation) and findings (distinct, sorted labels a slot); images without any annotation stay in images.

    Files are read in byte ranges, so neither a large one nor many are a task's; ids hold within a file. An annotation of a category
    that its file doesn't name is an error; one of an image that it doesn't name belongs to none.
    """
    raw = json_ranges.members(spark, path)
    part = lambda c: raw.where(F.col("section") == c).select("path", F.from_json("json", SECTIONS[c], {"mode": "FAILFAST"}).alias("x")).select("path", "x.*")
    images = part("images").select(F.col("id").alias("image_id"), "file_name", stem(F.col("file_name")).alias("case_id"), F.lit(split).alias("split"), "path")
    boxes = part("annotations")
    for level, name in ((1, "quadrant"), (2, "position"), (3, "condition")):
        key = f"category_id_{level}"
        names = part(f"categories_{level}").select("path", F.col("id").alias(key), F.col("name").alias(name))
        unknown = F.raise_error(F.concat(F.lit(f"unknown {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")
        boxes = boxes.join(names, ["path", key], "left").withColumn(name, F.coalesce(name, unknown))
    boxes = boxes.join(images.select("path", "image_id", "case_id"), ["path", "image_id"]).select("path", "image_id", "case_id", F.concat("quadrant", "position").cast("int").alias("slot"), "condition", "bbox")
    findings = boxes.groupBy("path", "image_id", "case_id", "slot").agg(F.array_sort(F.collect_set("condition")).alias("conditions"))
    return {"images": images, "boxes": boxes, "findings": findings}


def annotated_cases(parts: dict[str, DataFrame]) -> DataFrame:
    """case_id, file_name, split and findings (a map from slot to conditions) of every image, empty for those without annotations."""
    maps = parts["findings"].groupBy("path", "image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "conditions")))).alias("findings"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<array<string>>"))
    return parts["images"].join(maps, ["path", "image_id"], "left").withColumn("findings", F.coalesce("findings", none))


def annotation_inventory(parts: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """One row: images and raw annotations of a file, images that exist (files: file_name and length) and don't, and the latter's names."""
    there = files.where("length > 0").select("file_name").distinct().withColumn("there", F.lit(True))
    images = parts["images"].join(there, "file_name", "left").agg(
        F.count("*").alias("n_images_json"), F.count("there").alias("n_images_on_disk"), F.count_if(F.col("there").isNull()).alias("n_missing_files"),
        F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("file_name")))).alias("missing_files"),
    )
    return images.crossJoin(parts["boxes"].agg(F.count("*").alias("n_annotations_raw")))


def usable(cases: DataFrame, images: DataFrame) -> DataFrame:
    """Cases with a readable image."""
    return cases.join(images.where("readable").select("case_id"), "case_id", "left_semi")


def object_numbers(first: int = 1, last: int = 32) -> Column:
    """The distinct integers of a record's titles that lie in the range."""
    titles = F.transform(F.coalesce(F.col("Label.objects"), F.array()), lambda o: o["title"])
    numbers = F.flatten(F.transform(titles, lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))))
    return F.array_distinct(F.filter(numbers, lambda n: n.between(first, last)))


def complement(seen: Column | str, first: int, last: int) -> Column:
    return F.array_except(F.sequence(F.lit(first), F.lit(last)), F.col(seen) if isinstance(seen, str) else seen)


def missing_from_objects(records: DataFrame, first: int = 1, last: int = 32) -> DataFrame:
    """case_id and its missing numbers: the complement of all integers in the titles. Of records with one id the last (by `pos`) counts."""
    rows = records.where(F.length(F.coalesce("External ID", F.lit(""))) > 0).select(stem(F.col("External ID")).alias("case_id"), "pos", object_numbers(first, last).alias("seen"))
    rows = rows.groupBy("case_id").agg(F.max_by("seen", "pos").alias("seen"))
    return rows.select("case_id", complement("seen", first, last).alias("missing"))


def object_support(records: DataFrame, images: DataFrame | None = None, first: int = 1, last: int = 32) -> DataFrame:
    """One row: n_cases, n_slots, missing and present of all records; with images, only of those with an id and a readable image. Repeated ids count each time."""
    rows = records.select(stem(F.col("External ID")).alias("case_id"), F.size(object_numbers(first, last)).alias("n"))
    if images is not None:
        rows = usable(rows.where(F.length(F.coalesce("case_id", F.lit(""))) > 0), images)
    slots, whole = last - first + 1, lambda c, a: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(a)
    return rows.agg(F.count("*").alias("n_cases"), (F.count("*") * slots).alias("n_slots"), whole(F.lit(slots) - F.col("n"), "missing"), whole("n", "present"))


def salvaged_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files, read in byte ranges: path, pos, json and truncated. Of an array that is cut short the whole records before the cut; of an object its values."""
    return json_ranges.elements(spark, path)


def object_file(spark: SparkSession, path: str) -> DataFrame:
    return salvaged_array(spark, path).select("path", "pos", "truncated", F.from_json("json", OBJECTS).alias("r")).select("path", "pos", "truncated", "r.*")


def labelme_files(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """case_id and shapes of LabelMe documents: a file each, named by the file, or, where packed, a line each, named by its imagePath.

    Packed files are split by bytes and are as many as their writer had tasks, so neither the driver nor a task has work for each case.
    """
    if not packed:
        return spark.read.schema(SHAPES).option("multiLine", True).json(path).select(stem(F.col("_metadata.file_path")).alias("case_id"), "shapes")
    return spark.read.schema(f"imagePath string, {SHAPES}").json(path).select(stem(F.col("imagePath")).alias("case_id"), "shapes")


def labelme_findings(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """case_id, slot and conditions in first-seen order, from labels like `1-word-15` of labelme_files; white space around the parts doesn't count."""
    raw = labelme_files(spark, path, packed).select("case_id", F.posexplode("shapes").alias("pos", "shape"))
    parts = F.split(F.col("shape.label"), "-")
    words = F.create_map(*(F.lit(x) for pair in LABEL_WORDS.items() for x in pair))
    place = F.trim(F.element_at(parts, -1))
    rows = raw.where(F.size(parts) >= 3).where(place.rlike(r"^\d+$")).select("case_id", "pos", words[F.lower(F.trim(parts[1]))].alias("condition"), place.try_cast("int").alias("slot"))
    rows = rows.where(F.col("condition").isNotNull() & F.col("slot").isin(*SLOTS)).groupBy("case_id", "slot", "condition").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "condition")))
    return rows.groupBy("case_id", "slot").agg(F.transform(ordered, lambda x: x["condition"]).alias("conditions"))


def labelme_cases(images: DataFrame, findings: DataFrame) -> DataFrame:
    """Every image's case_id and findings, a map from slot to conditions; empty for images without a file, shapes or known labels."""
    maps = findings.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "conditions")))).alias("findings"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<array<string>>"))
    return images.select("case_id").join(maps, "case_id", "left").withColumn("findings", F.coalesce("findings", none))


def split(parts: dict[str, DataFrame], name: str, held_out: DataFrame) -> DataFrame:
    """One split, `qed` (train and val) or `all`; held-out cases are left out of train, qed and all."""
    members = {"qed": ["train", "val"], "all": ["train", "val", "test"]}.get(name, [name])
    out = parts[members[0]]
    for other in members[1:]:
        out = out.unionByName(parts[other])
    return out.join(held_out.select("case_id"), "case_id", "left_anti") if name in ("train", "qed", "all") else out


def assert_no_leak(cases: DataFrame, held_out: DataFrame) -> DataFrame:
    """cases, unless one of them is held out: then evaluating the row is an error."""
    marked = cases.join(held_out.select("case_id").distinct().withColumn("__held", F.lit(True)), "case_id", "left")
    leak = F.raise_error(F.concat(F.lit("held-out case "), F.col("case_id").cast("string"))).cast("boolean")
    return marked.where(F.when(F.col("__held"), leak).otherwise(F.lit(True))).drop("__held")


def reports(table: DataFrame, order: str) -> DataFrame:
    """case_id, report and stratum of rows with image (bytes, path) and report; a missing path is named by its place."""
    place = F.col(order).cast("string")
    name = F.coalesce(F.nullif(F.col("image.path"), F.lit("")), F.concat(place, F.lit(".jpg")))
    return table.select(F.concat(F.lit("pr_"), stem(name)).alias("case_id"), "report", stratum(F.coalesce("report", F.lit(""))).alias("stratum"))


def run_files(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Run payloads with the path they come from."""
    return spark.read.schema(RUN).option("multiLine", True).option("pathGlobFilter", pattern).json(folder).withColumn("path", F.col("_metadata.file_path"))


def run_results(runs: DataFrame) -> DataFrame:
    """A row a case and model, failed ones too: dataset, strategy, model and the result's fields."""
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    models = runs.select(first("dataset", "run_config.dataset").alias("dataset"), first("strategy", "run_config.strategy").alias("strategy"), F.explode("models").alias("model", "m"))
    return models.select("dataset", "strategy", "model", F.explode("m.results").alias("r")).select("dataset", "strategy", "model", case_name().alias("image"), "r.*")


def case_name() -> Column:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(blank("r.case_id"), blank("r.file_name"), F.lit("unknown"))


def exploded_findings(rows: DataFrame, keys: list[str], findings: str) -> DataFrame:
    """keys, slot and condition of a map column from slot to conditions."""
    return rows.select(*keys, F.explode(findings).alias("slot", "__c")).select(*keys, F.col("slot").cast("int").alias("slot"), F.explode("__c").alias("condition")).distinct()


def finished_runs(spark: SparkSession, logs: str, sentinel: str) -> DataFrame:
    """run (stem of the log's name) of logs that hold the sentinel."""
    lines = spark.read.text(logs).select(stem(F.col("_metadata.file_path")).alias("run"), "value")
    return lines.where(F.col("value").contains(sentinel)).select("run").distinct()


#: How PNG and JPEG files begin and end, in hexadecimal digits.
WHOLE_IMAGE = "^(89504E470D0A1A0A.*49454E44AE426082|FFD8FF.*FFD9)$"


def image_files(spark: SparkSession, folder: str, types: tuple[str, ...] = IMAGE_TYPES) -> DataFrame:
    """case_id, path, length and readable of the first image of each stem in the order of types.

    Readable means not empty, and begun and ended like a PNG or JPEG file; pixels aren't decoded.
    """
    files = spark.read.format("binaryFile").load(folder)
    ends = F.concat(F.hex(F.substring("content", 1, 8)), F.hex(F.expr("substring(content, -8, 8)")))
    files = files.select("path", "length", stem(F.col("path")).alias("case_id"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("type"), ((F.col("length") > 8) & ends.rlike(WHOLE_IMAGE)).alias("readable"))
    place = F.array_position(F.array(*map(F.lit, types)), F.col("type"))
    first = F.min_by(F.struct("path", "length", "readable"), place).alias("x")
    return files.where(place > 0).groupBy("case_id").agg(first).select("case_id", "x.*")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def case_list(spark: SparkSession, path: str, field: str = "case_ids") -> DataFrame:
    return spark.read.schema(f"{field} array<string>").option("multiLine", True).json(path).select(F.explode(field).alias("case_id"))


def references(spark: SparkSession, path: str) -> DataFrame:
    fields = "eval_cases array<struct<case_id:string,file_name:string,image_path:string,stratum:string,expert_report:string>>"
    return spark.read.schema(fields).option("multiLine", True).json(path).select(F.explode("eval_cases").alias("c")).select("c.*")


def with_reference(rows: DataFrame, references_: DataFrame, default: str | None = "") -> DataFrame:
    """rows with their case's `reference`; `default` where there is none, or, if that is None, no row."""
    known = references_.select("case_id", F.col("expert_report").alias("reference")).dropDuplicates(["case_id"])
    if default is None:
        return rows.join(known, "case_id")
    return rows.join(known, "case_id", "left").withColumn("reference", F.coalesce("reference", F.lit(default)))


def held_out_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id of the held-out list, and its exemplars' role and findings where it has them."""
    schema = f"case_ids array<string>, exemplars array<struct<case_id:string,role:string,gt:{FINDINGS}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    told = raw.select(F.explode("exemplars").alias("e")).select("e.case_id", "e.role", F.col("e.gt").alias("findings"))
    return raw.select(F.explode("case_ids").alias("case_id")).join(told, "case_id", "left")


def first_boxes(findings: DataFrame, boxes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """findings with `bbox`, that of their key's first box in the given order; null if there is none."""
    first = boxes.groupBy(*keys).agg(F.min_by("bbox", order).alias("bbox"))
    return findings.join(first, keys, "left")

"""COCO files as tables, and tables as COCO files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import names as N
from tessella.functions import polygon as P
from tessella.functions import rle as R
from tessella.operators.coco import assert_none
from tessella.sources.vector import text_document

_ANNOTATION = "struct<id:bigint,segmentation:string,is_rle_format:boolean,area:double,iscrowd:int,image_id:bigint,bbox:array<double>,category_id:bigint,score:double,other_attributes:map<string,string>>"
_IMAGE = "struct<id:bigint,width:int,height:int,file_name:string,min_x:double,max_x:double,min_y:double,max_y:double>"
_CATEGORY = "struct<id:bigint,name:string,supercategory:string,other_names:array<string>>"
SCHEMA = f"images array<{_IMAGE}>, point_cloud array<{_IMAGE}>, annotations array<{_ANNOTATION}>, categories array<{_CATEGORY}>"


def read_coco(spark: SparkSession, paths: str | list[str], fold: str | None = None, recursive: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``images, annotations, categories``, each with ``doc`` (the file's path).

    ``fold``: only files whose name says so; names that aren't COCO names are skipped then.
    Point-cloud documents keep their tiles under ``point_cloud``; both kinds read alike.
    """
    reader = spark.read.schema(SCHEMA).option("multiLine", True)
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    docs = reader.json(paths).select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_name").alias("doc_name"), "*")
    if fold is not None:
        own = F.coalesce(N.COCO.field(F.col("doc_name"), "fold"), N.CLOUD_COCO.field(F.col("doc_name"), "fold"))
        docs = docs.where(own == fold)
    tiles = F.coalesce(F.when(F.size("images") > 0, F.col("images")), F.col("point_cloud"))
    flat = lambda c: docs.select("doc", F.inline(c))
    return flat(tiles), flat(F.col("annotations")), flat(F.col("categories"))


def segmentation_shape(annotations: DataFrame, height: str | None = None) -> DataFrame:
    """``shape`` of coordinate-list segmentations and ``runs`` of run-length ones; the flag or the form of the text tells which."""
    text = F.col("segmentation")
    is_rle = F.coalesce("is_rle_format", F.lit(False)) | F.startswith(F.ltrim(text), F.lit("{"))
    lists = F.from_json(text, "array<array<double>>")
    packed = F.from_json(text, "counts string, size array<int>")
    return annotations.withColumns({
        "shape": F.when(~is_rle, P.of_coco(lists)),
        "runs": F.when(is_rle, R.decoded(packed["counts"])),
        "mask_height": F.when(is_rle, packed["size"][0]),
    })


def annotation_box(annotations: DataFrame) -> DataFrame:
    """``box_of`` each annotation: its bbox field if it has one, else the bounds of its segmentation."""
    given = F.col("bbox")
    at = lambda i: F.get(given, F.lit(i))
    explicit = F.struct(at(0).alias("minx"), at(1).alias("miny"), (at(0) + at(2)).alias("maxx"), (at(1) + at(3)).alias("maxy"))
    of_shape = P.coco_bounds(F.from_json("segmentation", "array<array<double>>"))
    return annotations.withColumn("box_of", F.when(F.size(given) == 4, explicit).otherwise(of_shape))


def check_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> None:
    """Ids are unique and every annotation's image and category exist (-1 and null categories pass)."""
    for name, df in (("image", images), ("annotation", annotations), ("category", categories)):
        assert_none(df.groupBy("id").count().where("count > 1"), f"an {name} id stands more than once")
    assert_none(annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "an annotation has no image")
    known = annotations.where("category_id is not null and category_id <> -1")
    assert_none(known.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti"), "an annotation has no category")


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, description: str = "", tiles_key: str = "images") -> None:
    """One COCO document in one file, its lines sorted by section and id and written in parallel; a null score is left out."""
    section = lambda k, df: df.select(F.lit(k).alias("section"), F.col("id").cast("long").alias("id"), F.to_json(F.struct(*df.columns)).alias("value"))
    body = section(0, images).unionByName(section(1, annotations)).unionByName(section(2, categories))
    # the first line of each section opens it, so the lists need no look ahead
    marks = [(0, '],"annotations":['), (1, '],"categories":[')]
    spark = images.sparkSession
    breaks = spark.createDataFrame([(s, 1 << 62, m) for s, m in marks], "section int, id long, value string")
    lines = body.unionByName(breaks).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("value")
    info = F.to_json(F.struct(F.lit(description).alias("description"), F.lit("1.0").alias("version"))).alias("info")
    head = '{"info":' + spark.range(1).select(info).first()[0] + f',"licenses":[],"{tiles_key}":['
    text_document(lines, path, head, "]}")


def write_folds(images: DataFrame, annotations: DataFrame, categories: DataFrame, folds: DataFrame, k: int, path: str, product: str, specifier: str) -> list[str]:
    """2 k documents: a train and a valid one for each fold; ``folds(image_id, fold, part)``."""
    out = []
    for fold in range(k):
        for part in ("train", "valid"):
            chosen = folds.where((F.col("fold") == fold) & (F.col("part") == part)).select("image_id")
            own = images.join(chosen.select(F.col("image_id").alias("id")), "id", "left_semi")
            target = f"{path}/{product}_coco_{specifier}_{part}{fold}.json"
            write_coco(own, annotations.join(chosen, "image_id", "left_semi"), categories, target)
            out.append(target)
    return out


"""Record, change and document schemas."""

from pyspark.sql import types as T

PARENT = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "code", "source", "paperSize", "note", "createdAt")])
CHILD = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in ("id", "rubbingId", "position", "type", "beforePhotoUrl", "afterPhotoUrl", "status", "repairNote", "batchId", "createdAt", "repairedAt")
    ]
)
BATCH = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("damageIds", T.ArrayType(T.StringType())),
        T.StructField("note", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField("completedAt", T.StringType()),
    ]
)
KINDS = {"rubbing": PARENT, "damage": CHILD, "batch": BATCH}
LISTS = {"rubbing": "rubbings", "damage": "damages", "batch": "batches"}
ARCHIVE = T.StructType([T.StructField(LISTS[k], T.ArrayType(s)) for k, s in KINDS.items()])
SNAPSHOT = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("data", ARCHIVE)])
#: One row for each operation; those of one commit share seq and are ordered by sub.
CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("sub", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)
#: Field order, weights and labels.
FIELDS = ("code", "damageType", "source", "name", "other")
WEIGHTS = {"code": 10, "damageType": 8, "source": 6, "name": 4, "other": 2}
FIELD_LABELS = {"code": "编号", "source": "来源", "damageType": "病害类型", "name": "名称/位置", "other": "备注信息"}
KIND_LABELS = {"rubbing": "拓片", "damage": "缺损项", "batch": "修补批次"}

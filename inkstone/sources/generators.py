"""Deterministic test archives: a seeded generator and a closed-form one."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.schema import BATCH, CHILD, PARENT

# Fixed values of the seeded archive.
SOURCES = ["地方碑刻残页", "馆藏拓片征集", "考古发掘出土", "民间捐赠旧拓", "寺院经幢拓本", "地方志石刻", "摩崖石刻拓片", "墓誌銘拓本"]
TYPES = ["虫蛀孔", "撕裂", "霉变", "缺损", "水渍", "折痕断裂", "烟熏变色", "墨迹脱落"]
POSITIONS = ["左上角", "下边缘中央", "右上角题字旁", "中部折痕处", "右侧边缘", "碑额位置", "左下角", "正文第三列"]
DYNASTIES = ["清", "明", "宋", "唐", "元", "漢", "魏"]
NOTES = ["边缘有旧折痕", "纸色偏黄", "保存状态一般", "曾做过托裱", "墨色较浓", "局部酥脆", "背面有旧衬纸", ""]


def _random(seed: int):
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) % (1 << 32)
        yield state / (1 << 32)


def seeded_archive(spark: SparkSession, count: int = 100_000, seed: int = 20260915) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, children and batches drawn from one sequential generator (hence made on the driver)."""
    draw = _random(seed)
    below = lambda n: int(next(draw) * n)
    pick = lambda values: values[below(len(values))]

    def moment(days: int) -> str:
        at = datetime(2026, 9, 15, tzinfo=UTC) - timedelta(days=below(days))
        hour, minute = below(24), below(60)
        return f"{at:%Y-%m-%d}T{hour:02d}:{minute:02d}:00.000Z"

    n_parents, n_batches = max(1, count // 3), count // 12
    parents, children, batches = [], [], []
    for i in range(n_parents):
        dynasty, source = pick(DYNASTIES), pick(SOURCES)
        size = f"{30 + below(40)}x{50 + below(50)}cm"
        parents.append((f"rub_seed_{i:07d}", f"TP-{dynasty}-{i % 1000:03d}", source, size, pick(NOTES), moment(365 * 5)))
    for i in range(max(0, count - n_parents - n_batches)):
        parent, position, type_ = parents[below(n_parents)][0], pick(POSITIONS), pick(TYPES)
        status = "pending" if next(draw) > 0.4 else "repaired"
        created = moment(365 * 5)
        repaired = moment(365 * 2) if next(draw) > 0.4 else None
        children.append((f"dmg_seed_{i:07d}", parent, position, type_, f"https://example.local/before/{i}.jpg", "", status, "", None, created, repaired))
    for i in range(n_batches):
        members = [children[below(len(children))][0] for _ in range(1 + below(6))]
        status = "open" if next(draw) > 0.5 else "completed"
        batches.append((f"bat_seed_{i:07d}", f"{2024 + i % 3}年第{i + 1}批修补", status, members, "", moment(365 * 3), None))
    return spark.createDataFrame(parents, PARENT), spark.createDataFrame(children, CHILD), spark.createDataFrame(batches, BATCH)


def closed_form_archive(spark: SparkSession, count: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An archive whose rows are functions of their number, made by the executors."""
    n_parents, i = count // 3, F.col("id")
    n_children = count - n_parents - count // 12
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    none = F.lit(None).cast("string")

    def day(year: int):
        return F.concat(F.lit(f"{year}-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 27 + 1).cast("string"), 2, "0"), F.lit("T00:00:00.000Z"))

    parents = spark.range(n_parents).select(
        F.concat(F.lit("r"), i).alias("id"), F.concat(F.lit("TP-"), of(DYNASTIES[:5]), F.lit("-"), F.lpad((i % 1000).cast("string"), 3, "0")).alias("code"),
        of(SOURCES).alias("source"), F.lit("40x70cm").alias("paperSize"), F.when(i % 5 == 0, "边缘旧折痕").otherwise("").alias("note"), day(2024).alias("createdAt"),
    )
    children = spark.range(n_children).select(
        F.concat(F.lit("d"), i).alias("id"), F.concat(F.lit("r"), i % n_parents).alias("rubbingId"), of(["左上角", "下边缘中央", "右上角", "中部折痕"]).alias("position"),
        of(TYPES).alias("type"), none.alias("beforePhotoUrl"), none.alias("afterPhotoUrl"), F.when(i % 3 == 0, "repaired").otherwise("pending").alias("status"),
        F.lit("").alias("repairNote"), none.alias("batchId"), day(2024).alias("createdAt"), none.alias("repairedAt"),
    )
    batches = spark.range(count - n_parents - n_children).select(
        F.concat(F.lit("b"), i).alias("id"), F.concat(F.lit("2025年第"), i + 1, F.lit("批修补")).alias("name"), F.lit("open").alias("status"),
        F.array().cast("array<string>").alias("damageIds"), F.lit("").alias("note"), day(2025).alias("createdAt"), none.alias("completedAt"),
    )
    return parents, children, batches

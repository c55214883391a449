import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as X

PAIRS = [
    ("ＴＰ－清　０１４", "TP-清 014"), ("（虫蛀）", "(虫蛀)"), ("ABCxyz", "abcxyz"), ("Tp-Q-01", "tp-q-01"), ("蟲蛀孔與撕裂", "虫蛀孔与撕裂"),
    ("舊紙張發黴", "旧纸张发霉"), ("裝幀損傷", "装帧损伤"), (" 虫  蛀　孔 ", "虫蛀孔"), ("TP\t清-014/①", "tp清014①"), ("虫蛀孔、（撕裂）", "虫蛀孔撕裂"),
]


def test_normal_forms_agree(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string").select("a", X.norm(spark, F.col("a")).alias("x"), X.norm(spark, F.col("b")).alias("y")).collect()
    for r in rows:
        assert r.x == r.y == X.norm_text(spark, r.a)


def test_null_is_empty(spark):
    assert spark.sql("select cast(null as string) x").select(X.norm(spark, F.col("x"))).first()[0] == ""
    assert X.norm_text(spark, None) == ""


def test_reign_name_stays(spark):
    assert X.norm_text(spark, "乾隆後漢") == "乾隆后汉"


def test_segments():
    s = X.segments("tp清014虫蛀")
    assert set(s["latin"]) == {"tp", "014"} and set(s["cjk"]) == {"清", "虫蛀"}
    assert X.segment_grams("虫蛀孔") == [["虫蛀", "蛀孔", "虫", "孔"]]


def test_tokens(spark):
    d = spark.createDataFrame([("tp清014虫蛀孔虫",), ("",)], "x string").select(X.tokens(F.col("x"))).collect()
    assert set(d[0][0]) == {"tp", "014", "清", "虫蛀", "蛀孔", "孔虫", "虫", "蛀", "孔"} and d[1][0] == []


@pytest.mark.parametrize(
    "needle,hay,piece",
    [("虫蛀孔", "左上角虫柱孔处", "虫柱孔"), ("撕裂", "下边缘斯裂", "斯裂"), ("虫", "柱", None), ("虫蛀孔", "虫某某", None), ("撕裂", "裂开", None)],
)
def test_window(spark, needle, hay, piece):
    got = spark.createDataFrame([(hay,)], "n string").select(X.window(F.col("n"), needle)).first()[0]
    assert got == piece or (piece and got and abs(len(got) - len(needle)) <= 1)


def test_near_pieces_of_strings_are_windows(spark):
    import random

    from inkstone.operators.search import near_piece

    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))) for _ in range(60)]
    for q in {q for _, q in pairs}:
        mine = sorted({n for n, x in pairs if x == q})
        rows = spark.createDataFrame([(n,) for n in mine], "n string").select("n", X.window(F.col("n"), q).alias("w")).collect()
        for r in rows:
            assert near_piece(r.n, q) == r.w

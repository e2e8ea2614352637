"""Text repair and transliteration."""
import pytest
from pyspark.sql import functions as F

from ranklab.functions import text as X


def _all(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_no_script_is_lost(spark):
    got = _all(spark, X.clean_text, ["École Ünder Привет 東京", "Straße, Œuvre & Þórr!", "Αθήνα ω", "ﬁne Ａ１ … x²", "", None, "नमस्ते", "e\u0301te\u0301", "  -- "])
    assert got == ["ecole under privet 東京", "strasse oeuvre thorr", "athena o", "fine a1 x2", "", None, "नमस्ते", "ete", ""]
    assert _all(spark, lambda c: X.clean_text(c, lower=False), ["École Щит"]) == ["Ecole Shchit"]
    assert _all(spark, lambda c: X.clean_text(c, alnum=False), ["„Ja“ – «no»…"]) == ['"ja" - <<no>>...']


@pytest.mark.parametrize("charset", ["cp1252", "latin-1"])
def test_repair_undoes_every_layer(spark, charset):
    good = ["déjà vu", "naïve “quotes” — dash", "Ωμέγα и Привет", "日本語 text", "😀 ok", "plain", "", "Äpfel über Öl ñ ç"]
    bad = []
    for t in good:
        layers = 0
        for _ in range(3):
            try:
                t = t.encode("utf-8").decode(charset)
                layers += 1
            except UnicodeDecodeError:
                break
        bad.append(t)
    assert _all(spark, X.repair_text, bad) == good
    assert sum(a != b for a, b in zip(bad, good)) >= 4


def test_repair_leaves_good_text(spark):
    good = ["„Fuß“ und «voilà»", "Señor Ñandú", "ÀÉÎÕÜ", "naïve café — «ça»", "Ã", "â", "PÃO à la", None]
    assert _all(spark, X.repair_text, good) == good
    assert _all(spark, X.repair_text, ["Ã© but Straße “x”"]) == ["é but Straße “x”"]

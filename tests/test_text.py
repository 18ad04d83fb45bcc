import pytest
from pyspark.sql import functions as F

from linkstone.functions import similarity as S
from linkstone.functions import text as T

ADDRESS = "business_address"


def names(spark, *raw):
    df = spark.createDataFrame([(i, r, "") for i, r in enumerate(raw)], "seq long, business_name string, business_address string")
    return [r for r in T.profiled(df).orderBy("seq").collect()]


def addresses(spark, *raw):
    df = spark.createDataFrame([(i, "", r) for i, r in enumerate(raw)], "seq long, business_name string, business_address string")
    return [r for r in T.profiled(df).orderBy("seq").collect()]


@pytest.mark.parametrize(
    "latin, indic",
    [
        ("Raj Investments LLP", "ராஜ் இன்வெஸ்ட்மெண்ட்ஸ் எல்எல்பி"),
        ("Ss Food Private Limited", "एसएस फूड प्राइवेट लिमिटेड"),
        ("Aditya Properties LLP", "आदित्य प्रॉपर्टीज एलएलपी"),
        ("Red Ventures Private Limited", "रेड वेंचर्स प्राइवेट लिमिटेड"),
    ],
)
def test_indic_names(spark, latin, indic):
    a, b = names(spark, latin, indic)
    assert b.clean_name and S.token_set(a.clean_name, b.clean_name) >= 50


def test_indic_spelling(spark):
    got = [r.t for r in spark.createDataFrame([("प्राइवेट लिमिटेड",), ("एलएलपी",), ("वेंचर्स",), ("Œuvre ß é",), (None,)], "x string").select(T.transliterate(F.col("x")).alias("t")).collect()]
    assert got == ["praaivett limittedd", "elelpii", "vencrs", "OEuvre ss e", ""]


def test_french(spark):
    a, b, c, d = addresses(spark, "SCI Ptit Àmicale", "NO. 5 ALLÉE DES HÊTRES", "Thermal & Fils SASU", "Bordeaux, Nouvelle-Aquitaine, CEDEX 02")
    assert "sci" in a.clean_addr and "allee" in b.clean_addr and "thermal" in c.clean_addr and d.clean_addr == "bordeaux nouvelle aquitaine"


def test_domain(spark):
    a, b = names(spark, "Orelee's Barbershop", "http://www.oreleesbarbershop.com")
    assert (a.compressed, b.compressed) == ("oreleebarbershop", "oreleesbarbershop") and S.indel(a.compressed, b.compressed) >= 90
    strict = spark.createDataFrame([("x.info",), ("A.Company",), ("b.com",)], "x string").select(T.domain_stem(F.col("x"), compat=False).alias("s")).collect()
    assert [r.s for r in strict] == ["x", "", "b"]


def test_anchors(spark):
    got = addresses(spark, "KH NO. -570/13, NEW DELHI, WEST DELHI, 110041", "1795 Westchester Drive, High Point, NC 27265", "20 Rue Parmentier, Dunkerque, 59140", None, "300 Swift Avenue, Unit 5, Durham, NC")
    assert [(r.door, r.pin) for r in got] == [("570", "110041"), ("1795", "27265"), ("20", "59140"), ("", ""), ("300", "")]
    assert got[4].addr_keys == ["300_swift", "300_unit"]


def test_profiles(spark):
    df = spark.createDataFrame([("Société Générale Ltd & Co", "12 St Marks Rd")], "n string, a string")
    row = df.select(*[F.array_join(T.name_tokens("n", p), " ").alias(p) for p in ("P", "C", "V6", "L")], T.clean_addr("a", "L").alias("addr")).first()
    assert (row.P, row.C, row.V6, row.L, row.addr) == ("societe generale ltd co", "societe generale", "soci rale", "soci rale", "12 street marks road")


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_similarities():
    import random

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(70))) for _ in range(2))
        assert S.lcs(a, b) == slow_lcs(a, b)
    assert S.lcs("kitten", "sitting") == 4 and S.indel("", "") == 100 and S.indel("a", "") == 0
    assert S.token_sort("b a", "a b") == 100 and S.token_set("a b c", "c a") == 100 and S.token_set("", "a") == 0 and S.token_set("x", "y") == 0
    assert abs(S.jaro_winkler("martha", "marhta") - 0.961111) < 1e-6 and S.jaro_winkler("", "") == 1
    assert S.partial("abc", "xxabcxx") == 100 and S.partial("", "a") == 0 and 0 < S.partial("abcd", "zzabd") < 100


def test_trigrams(spark):
    rows = [("", "abc"), ("ab", "ab"), ("ab", "abc"), ("abcd", "bcde"), ("abc", "abc")]
    got = spark.createDataFrame(rows, "a string, b string").select(S.trigram_jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [round(r.j, 6) for r in got] == [0, 1, 0, 0.333333, 1]

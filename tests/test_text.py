import pytest
from pyspark.sql import functions as F

from linkloom.functions import minhash, text
from linkloom.operators import features


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*cols).first()


@pytest.mark.parametrize(
    "raw, name, two, three, grams",
    [
        ("ACME Co., Ltd.", "acme", ["acme"], ["acme"], ["acm", "cme"]),
        ("L.L.C. Foo", "l l c foo", ["foo"], ["foo"], ["llc", "lcf", "cfo", "foo"]),
        ("Group Services Co", "", [], [], []),
        ("Müller & Söhne GmbH", "müller söhne", ["müller", "söhne"], ["müller", "söhne"], ["mül", "üll", "lle", "ler", "ers", "rsö", "söh", "öhn", "hne"]),
        ("  A-1  Pest_Control,Inc ", "a 1 pest control", ["pest", "control"], ["pest", "control"], ["a1p", "1pe", "pes", "est", "stc", "tco", "con", "ont", "ntr", "tro", "rol"]),
        (None, "", [], [], []),
        ("NA", "na", ["na"], [], ["na"]),
        ("éco sa", "éco", ["éco"], ["éco"], ["éco"]),
    ],
)
def test_names(spark, raw, name, two, three, grams):
    norm = text.normalize_name("x")
    assert list(one(spark, raw, norm, text.tokens(norm), text.tokens(norm, 3), text.char_ngrams(norm))) == [name, two, three, grams]


def test_text_keeps_spaces(spark):
    assert one(spark, "ACME Co., Ltd.", text.normalize_text("x"))[0] == "acme co   ltd "


def test_codes_and_numbers(spark):
    s = "sw1a 1aa k1a 0b1 75008 1234567 123456"
    codes, numbers = one(spark, s, text.postal_codes("x"), text.numeric_tokens("x"))
    assert set(codes) == {"SW1A1AA", "K1A0B1", "75008", "123456"} and set(numbers) == {"75008", "1234567", "123456"}


def test_minhash(spark):
    sig, none = one(spark, "acme", minhash.signature(text.char_ngrams("x"), 16), minhash.signature(F.array().cast("array<string>"), 16))
    assert sig[:2] == [611384909, 1417455842] and none is None
    assert one(spark, "é1", minhash.ngram_hash(F.col("x")))[0] == 1119090321


GOLDEN = [
    (("Acme Trading Co., Ltd.", "12 Main St., Springfield 62701", "US"), ("ACME Tradng Inc", "12 Main Street Springfield, 62701", "us "), [0, 0.9166666666666666, 1 / 3, 0.5454545454545454, 1, 0.9166666666666666, 1, 0.8484848484848485, 2 / 3, 0.7777777777777778, 4, 0.9090909090909091, 1, 1, 1, 0, 0, 0, 0.47424242424242424]),
    (("Café Noir SA", None, "FR"), ("Cafe Noir", "3 Rue X 75008", None), [0, 0.8888888888888888, 1 / 3, 1 / 3, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0.26666666666666666]),
    (("Group Co", "1 A St", "GB"), ("Holdings Ltd", "9 B Rd SW1A 1AA", "GB"), [0, 1, 0, 0, 0, 0, 0, 0.19999999999999996, 0, 0, 0, 0.4, 0, 0, 1, 0, 0, 0, 0]),
]


@pytest.mark.parametrize("a, b, expected", GOLDEN)
def test_pair_features(spark, a, b, expected):
    schema = "entity_id string, business_name string, business_address string, country string"
    s1, cd = spark.createDataFrame([("S1-1", *a)], schema), spark.createDataFrame([("S2-1", *b)], schema)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-unknown")], "s1_id string, candidate_id string")
    rows = features.feature_matrix(pairs, s1, cd).collect()
    assert len(rows) == 1 and rows[0].label is None
    assert [rows[0][f] for f in features.FEATURES] == pytest.approx(expected, abs=1e-12)

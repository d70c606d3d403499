import pytest
from pyspark.sql import functions as F

from litquarry.llm import confusables
from litquarry.llm.lookalikes import canonical, consistent, look_classes, same_look_pairs, stored_forms


@pytest.mark.parametrize(("a", "b"), [
    ("tumour of the lung", "tumоur оf thе lung"),  # Cyrillic letters
    ("venous", "νenous"), ("ABC 123", "ＡＢＣ　１２３"), ("efficient flow", "eﬃcient ﬂow"), ("café", "café"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b"),
    ("Å", "Å"), ("µm", "μm"), ("post-op", "post‑op"), ("a\nb", "a\r\nb"), ("PAX8", "РАХ8"), ("группа образцов cop", "группа образцов сор"), ("при", "пpи"),
    ("once", "օnce"), ("ABC", "ᎪBC"), ("lang", "lɑng"), ("lung", "lunɡ"), ("lesion", "lesıon"), ("venous", "ѵenous"), ("κако", "како"), ("MTOR", "ꓟꓔꓳꓣ"),
])
def test_equal_looks(a, b):
    assert canonical(a)[0] == canonical(b)[0]


@pytest.mark.parametrize(("a", "b"), [
    ("Lung", "lung"), ("cafe", "café"), ("a.b", "ab"), ("x2", "x3"), ("cm2", "cm²"), ("H2O", "H₂O"), ("a b", "a\nb"), ("a b", "ab"), ("strasse", "straße"), ("α", "a"), ("β", "ß"), ("σ", "o"), ("рог", "рor"), ("1", "l"), ("I", "l"), ("O", "0"), ("rn", "m"), ("a  b", "a b"), ("ж", "x"),
])
def test_different_looks(a, b):
    assert canonical(a)[0] != canonical(b)[0]


def test_the_script_of_the_text_is_kept():
    assert canonical("Группа изучила")[0] == "Группа изучила"
    assert canonical("Η ομάδα εξέτασε")[0] == "Η ομάδα εξέτασε"
    assert canonical("tumоur") == ("tumour", 1, 0)
    assert canonical("the РАХ gene, found") == ("the PAX gene, found", 0, 1)


def test_idempotent():
    for t in ("tumоur оf ﬁbres", "пpи группe", "µm ＡＢ", "x" * 200_000):
        assert canonical(canonical(t)[0])[0] == canonical(t)[0]


def test_table(spark):
    rows = [(1, "lung"), (2, "lung"), (3, "l​ung"), (4, "ｌung"), (5, "Lung"), (6, None), (7, ""), (8, "​"), (3, "l​ung")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, form string, stored int")
    got = {tuple(r) for r in same_look_pairs(stored_forms(df, "doc_id", "text")).collect()}
    assert got == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert same_look_pairs(stored_forms(df.limit(0), "doc_id", "text")).count() == 0
    assert [r.form for r in df.select("doc_id", consistent(F.col("text"))["form"].alias("form")).filter("doc_id = 6").collect()] == [None]


def test_copies_are_paired_as_one_text(spark):
    df = spark.createDataFrame([(i, "same") for i in range(1_000)], "doc_id long, text string")
    assert same_look_pairs(stored_forms(df, "doc_id", "text")).count() == 0


def test_scripts_are_intersected():
    assert canonical("рroteіn") == ("protein", 1, 0)  # two Cyrillic letters among Latin ones
    assert canonical("Η ομάδα εξέτασε τοv ασθενή")[0] == "Η ομάδα εξέτασε τον ασθενή"  # a Latin v in a Greek word
    assert canonical("οбразец группы")[0] == "образец группы"
    assert canonical("μm and IL-1β, TGF-α")[0] == "μm and IL-1β, TGF-α"
    assert canonical("жω mixed")[0] == "жω mixed"  # no script spells both


def test_the_data_are_read():
    table = confusables.prototypes()
    assert table["а"] == "a" and table["ո"] == "n" and table["m"] == "rn" and len(table) > 6_000
    assert all(len(set(letters)) == len(letters) and set(s.values()) <= set(letters) for letters, s in confusables.classes())


def test_classes(spark):
    rows = [(1, "lung"), (2, "lung"), (3, "l\u200bung"), (5, "Lung"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in look_classes(stored_forms(df, "doc_id", "text")).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 5, 1)}

import pytest
from hypothesis import given
from hypothesis import strategies as st

from litquarry.operators.packed import Grammar, unpack

FALLBACK, ALWAYS = Grammar("fallback"), Grammar("always", blank_separates=True)


def values(text, grammar=FALLBACK):
    return [v for _, v, _ in grammar.parse(text)]


@pytest.mark.parametrize(("text", "expected"), [
    ("Smith, A; Jones, B ;", ["Smith, A", "Jones, B"]), ("A Smith, B Jones and C Lee", ["A Smith", "B Jones", "C Lee"]), ("A & B", ["A", "B"]),
    ("A|B || C / D；E\tF\nG", list("ABCDEFG")), ('["Smith, A","Lee"]', ["Smith, A", "Lee"]), ('"Fo ""Lil"" Lee"; "B"', ['Fo "Lil" Lee', "B"]),
    ("Trial, Phase II; Letter", ["Trial, Phase II", "Letter"]), ("Smith A, Lee B, et al.", ["Smith A", "Lee B"]), ("Smith A, Lee B et al", ["Smith A", "Lee B"]),
    ("n/a", []), ("Letter; n/a; -", ["Letter"]), (";;", []), ("", []), (None, []), ("  ", []), ("[Letter; Review]", ["Letter", "Review"]),
    ("[A; B]; C", ["A; B", "C"]), ("C; [A; B]", ["C", "A; B"]), ("[A]; [B; C]", ["A", "B; C"]), ("[[A; B]; C]", ["A; B", "C"]), ("[A], [B, C]", ["A", "B, C"]),
    ('["A; B"]; C', ["A; B", "C"]), ('[x "p]q" y]; z', ['x "p]q" y', "z"]), ("[]; A", ["A"]), ("[n/a]; A; B", ["A", "B"]),
])
def test_values(text, expected):
    assert values(text) == expected


def test_malformed_quotes_are_read_as_text_and_flagged():
    assert [(v, bad) for _, v, bad in FALLBACK.parse('"Smith, A; Lee')] == [('"Smith, A', True), ("Lee", False)]
    assert [(v, bad) for _, v, bad in FALLBACK.parse('"Smith" MD; Lee')] == [('"Smith" MD', True), ("Lee", False)]


def test_malformed_brackets_are_read_as_text():
    assert [(v, bad) for _, v, bad in FALLBACK.parse("[A; B")] == [("[A", True), ("B", False)]
    assert [(v, bad) for _, v, bad in FALLBACK.parse("A]; B")] == [("A]", True), ("B", False)]
    assert [(v, bad) for _, v, bad in FALLBACK.parse("[A] more; B")] == [("[A] more", False), ("B", False)]
    assert [(v, bad) for _, v, bad in FALLBACK.parse('["A; B]; C')][0][1]


@given(st.lists(st.text(st.characters(exclude_characters='\r\n[]"', exclude_categories=["Cs", "Cc"]), min_size=1).map(str.strip).filter(lambda v: v and v.lower() not in FALLBACK.missing), min_size=2, max_size=6))
def test_bracketed_lists_round_trip(items):
    assert values("; ".join(f"[{i}]" for i in items)) == items


def test_profiles_split_at_everything():
    assert values("a_b, c_and_d & e f and g", ALWAYS) == ["a_b", "c_and_d", "e", "f", "g"]


@given(st.lists(st.text(st.characters(exclude_characters="\r\n", exclude_categories=["Cs", "Cc"]), min_size=1).map(str.strip).filter(lambda v: v and v.lower() not in FALLBACK.missing), max_size=6))
def test_quoted_lists_round_trip(items):
    packed = "; ".join('"' + i.replace('"', '""') + '"' for i in items)
    assert values(packed) == items


def test_long_text_is_read_whole():
    assert len(values("; ".join(f"name {k}" for k in range(50_000)))) == 50_000


def test_unpack(spark):
    df = spark.createDataFrame([(1, "A; B", None, "item"), (1, "A; B", None, "item"), (2, "C", "x|y", None), (3, None, "", None)], "id long, names string, kinds string, item string")
    out = unpack(df, {"names": FALLBACK, "kinds": FALLBACK}, keep=("id",), min_values=2)
    rows = sorted(map(tuple, out.collect()))
    assert rows == [(1, "names", 1, "A", False)] * 2 + [(1, "names", 2, "B", False)] * 2 + [(2, "kinds", 1, "x", False), (2, "kinds", 2, "y", False)]
    assert unpack(df.limit(0), {"names": FALLBACK}, keep=("id",)).count() == 0
    with pytest.raises(ValueError, match="clash"):
        unpack(df, {"names": FALLBACK}, keep=("id", "item"))

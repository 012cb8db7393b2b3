"""Small cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import code as C
from corpusmill.functions import rules
from corpusmill.functions import text as T

FENCE = "```"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalise_covers_all_white_space(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    text = "a".join(spaces) + "b"
    assert one(spark, T.normalise_question(F.lit(text))) == " ".join(text.split())


def test_strip_fence(spark):
    made = f"x\n{FENCE}json\n {{}} \n{FENCE}\n{FENCE}\nlater\n{FENCE}"
    assert one(spark, T.strip_fence(F.lit(made))) == "{}"
    assert one(spark, T.strip_fence(F.lit("  plain "))) == "plain"


@pytest.mark.parametrize(
    ("text", "want"),
    [("none", "none"), (f"{FENCE}python\nab\n{FENCE} prose between them {FENCE}\nc\n{FENCE}", " prose between them "), (f"{FENCE}Python\nopen", "open"), (f"{FENCE}\na\n{FENCE}{FENCE}\nb\n{FENCE}", "a")],
)
def test_longest_block(spark, text, want):
    assert one(spark, T.longest_block(F.lit(text))) == want


@pytest.mark.parametrize(("n", "c", "k", "want"), [(10, 0, 1, 0.0), (10, 10, 5, 1.0), (10, 3, 3, 17 / 24), (10, 3, 5, 11 / 12), (1, 0, 3, -1.0), (1, 1, 1, 1.0)])
def test_pass_at_k(spark, n, c, k, want):
    assert one(spark, T.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(want, abs=1e-15)


def test_pass_at_k_can_be_null(spark):
    assert one(spark, T.pass_at_k(F.lit(1), F.lit(0), 3, null_when_undefined=True)) is None


@pytest.mark.parametrize("text", ["2024-04-01", "20240401", "202404", "2404"])
def test_cutoff(text):
    assert T.parse_cutoff(text) == dt.datetime(2024, 4, 1)


def test_bad_cutoff():
    with pytest.raises(ValueError):
        T.parse_cutoff("soon")


def test_rules():
    with pytest.raises(ValueError):
        rules.full_name([{"when": {"colour": "x"}, "template": "a"}], F.lit(""), F.lit(""), F.lit(""))
    assert rules.merged({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 1}
    assert rules.list_argument(["1,2", "[2, 3]"], int) == [1, 2, 3]
    assert rules.slots(["a", "b"], 3) == ["a", "a", "b"] and rules.slots(["a", "b", "c"], 2) == ["a", "b"]
    assert rules.call_prefixes("a.b", "m") == ["m"] and rules.call_prefixes("lib", "m") == ["m", "lib"]


def test_used_names():
    code = "k[1, 2](x)\nlib.a.b.c(lib.d)\nl.k[g, b](y)\nother.z()\nx = l.attr"
    assert C.used_names(code, ["l", "lib"], "lib") == ["lib.a.b.c", "lib.a", "lib.a.b", "lib.d", "lib.k", "lib.attr"]
    assert C.used_names("def (", ["l"], "lib") == []


def test_checked():
    good = "import lib as l\ndef f(x):\n    return l.a(x)\n"
    assert C.checked(good, "assert f(1)", "q", "import lib as l") == (True, "f", "")
    assert not C.checked(good, "f(1)", "q", "import lib as l")[0] and C.checked(good, "f(1)", "print it", "import lib as l")[0]
    assert not C.checked(good + "def g(): pass\n", "assert g()", "q", "import lib as l")[0]
    assert C.checked(good + "def g(): pass\n", "assert g[1](2)", "q", "import lib as l", 1, 2)[1] == "g"


def test_json_object():
    assert C.json_object('text {"a": "}"} tail') == {"a": "}"}
    assert C.json_object("[1]") is None and C.json_object("{") is None


def test_answer_and_test():
    a, t = "import lib\ndef f(): return lib.x()", "assert f()"
    both = f"{FENCE}python\n{t}\n{FENCE}\n{FENCE}python\n{a}\n{FENCE}"
    assert C.answer_and_test(both, "import lib") == (a.strip() + "\n", t.strip() + "\n", "")
    assert C.answer_and_test('{"answer_lines": ["a", "b"], "test_lines": ["c"]}', "import lib") == ("a\nb\n", "c\n", "")
    assert C.answer_and_test("nothing", "import lib")[2]


def test_docstrings_of_methods_stay():
    assert C.without_docstring('def f():\n    """d"""\n    return 1\n') == "def f():\n    return 1\n"
    method = '    def f(self):\n        """d"""\n        return 1\n'
    assert C.without_docstring(method) == method
    assert C.without_docstring('"""m"""\nx = 1\n', module=True) == "x = 1\n"

import pytest

from lodestrand.functions.formula import FormulaError, columns, parse
from lodestrand.plans.factors import sets
from lodestrand.plans.layers import lookback, tree


def test_binding_strength():
    assert parse("1 + 2 * x") == ("call", "ADD", ("num", 1.0), ("call", "MUL", ("num", 2.0), ("col", "x")))
    assert parse("-x^2") == ("call", "POW", ("call", "NEG", ("col", "x")), ("num", 2.0))
    assert parse("a ^ b ^ c")[2][1] == "POW"
    assert parse("a < b ? 1 : 2")[1] == "IF"
    assert parse("a < 1 || b > 2 && c == 3")[1] == "OR"


def test_names_and_windows():
    assert parse("max(close, 5)")[1] == "TSMAX"
    assert parse("max(close, open)")[1] == "GREATEST"
    assert parse("adv20") == ("call", "MEAN", ("col", "amount"), ("num", 20.0))
    assert columns(parse("indneutralize(vwap, IndClass.sector)")) == {"vwap", "sector"}
    assert tree("correlation(close, volume, 3.92795)")[-1] == ("num", 3)


@pytest.mark.parametrize("text", ["close +", "(close", "close $ open", "FOO(close", "1 2"])
def test_unreadable(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_unknown_operator():
    with pytest.raises(FormulaError):
        tree("FOO(close, 3)")


def test_lookback():
    assert lookback(tree("DELAY(MEAN(close, 20), 5)")) == 24
    assert lookback(tree("close")) == 0


def test_sets():
    assert len(sets.factor_set("wq101")) == 101
    assert len(sets.alpha158()) == 158
    assert len(sets.gtja191()) == 10
    assert len(sets.quant33()) == 33
    assert len(sets.barra()) == 10
    for name in sets.SETS:
        for formula in sets.factor_set(name).values():
            tree(formula)
    with pytest.raises(ValueError):
        sets.factor_set("gtja191", ["alpha11"])
    with pytest.raises(ValueError):
        sets.factor_set("nothing")

import pytest

from tsengine.plans import syntax as S
from tsengine.plans.durations import DurationError, automatic_step, format_duration, parse_config_duration, parse_duration, parse_time


@pytest.mark.parametrize(("text", "seconds"), [("5m", 300), ("1h30m", 5400), ("500ms", 0), ("1y", 31_536_000), ("2w", 1_209_600), ("1.5h", 5400)])
def test_durations(text, seconds):
    assert parse_duration(text) == seconds


@pytest.mark.parametrize("text", ["", "5", "m", "5x", "1h 30m"])
def test_no_durations(text):
    with pytest.raises(DurationError):
        parse_duration(text)


def test_other_times():
    assert format_duration(5400) == "1h30m"
    assert format_duration(0) == "0s"
    assert parse_config_duration("30") == 30
    assert parse_config_duration("100us") == 0
    assert parse_time("now-1h", 10_000) == 6400
    assert parse_time("1700000000.9") == 1_700_000_000
    assert parse_time("2024-01-01T00:00:00Z") == 1_704_067_200
    assert [automatic_step(x) for x in (60, 7200, 100_000, 700_000)] == [15, 60, 600, 3600]


@pytest.mark.parametrize(
    ("query", "canonical"),
    [
        ('sum(rate(m{env="p"}[5m])) by (job)', 'sum by (job)(rate(m{env="p"}[300s]))'),
        ("sum by (job) (m)", "sum by (job)(m)"),
        ("sum without (a,) (m)", "sum without (a)(m)"),
        ("-2^2", "(-2 ^ 2)"),
        ("2^3^2", "(2 ^ (3 ^ 2))"),
        ("1+2*3", "(1 + (2 * 3))"),
        ("a or b and c unless d", "(a or ((b and c) unless d))"),
        ("a == bool 1", "(a == bool 1)"),
        ("a / on (x) group_left (y) b", "(a / on (x) group_left (y) b)"),
        ("a * ignoring (x) group_right b", "(a * ignoring (x) group_right () b)"),
        ("x offset 5m @ 100", "x offset 300s @ 100.0"),
        ("x @ end()", "x @ end()"),
        ("max_over_time(rate(x[1m])[10m:30s])", "max_over_time(rate(x[60s])[600s:30s])"),
        ("rate(x[5m])[10m:]", "rate(x[300s])[600s:]"),
        ("topk(3, sum(x) by (j))", "topk(3, sum by (j)(x))"),
        ('count_values("v", x)', 'count_values("v", x)'),
        ('{__name__="up", a!="b"}', 'up{a!="b"}'),
        ('{"foo.bar", a=~"b.*"}', 'foo.bar{a=~"b.*"}'),
        ("up{a==b}", 'up{a="b"}'),
        ("a.b:c{x=1} # comment", 'a.b:c{x="1"}'),
        ("x{a='it\\'s'}", 'x{a="it\'s"}'),
        ("x{a=`raw\\n`}", 'x{a="raw\\\\n"}'),
        ("1e3 + .5", "(1000 + 0.5)"),
        ("NaN", "nan"),
        ("((x))", "x"),
        ("- x", "-x"),
        ("quantile(0.5, x)", "quantile(0.5, x)"),
    ],
)
def test_parse(query, canonical):
    assert str(S.parse(query)) == canonical


@pytest.mark.parametrize("query", ["", "  ", "x{", "x{a}", "{}", "sum()", "sum(a, b)", "topk(x)", "1h30m", "x[5m", "x[5]m", "rate(x[5m]) offset 5m", "a + bool b", "a b", "x{a=~'('}", "x @", "$", "sum(x) by x"])
def test_rejected(query):
    with pytest.raises(S.QuerySyntaxError):
        S.parse(query)


def test_walk_and_rewrite():
    tree = S.parse('sum(rate(m{a="b"}[5m])) / count(n)')
    assert [n.name for n in S.walk(tree) if isinstance(n, S.Selector)] == ["m", "n"]
    renamed = S.rewrite(tree, lambda n: S.Selector("z", n.matchers, n.window) if isinstance(n, S.Selector) else n)
    assert str(renamed) == '(sum(rate(z{a="b"}[300s])) / count(z))'

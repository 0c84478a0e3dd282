"""Keywords and phrases of the license rules skip no text that a rule matches."""

import random
import re

import pytest

from traceloom.llm import op3_licenses

_parser = re._parser


def _sentence(draw, parsed):
    """A text that the parsed pattern matches."""
    out = ""
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name == "ANY":
            out += draw.choice("abc")
        elif name == "IN":
            how, what = draw.choice(value)
            out += chr(what if str(how) == "LITERAL" else draw.randint(*what))
        elif name == "BRANCH":
            out += _sentence(draw, draw.choice(value[1]))
        elif name == "SUBPATTERN":
            out += _sentence(draw, value[3])
        elif name == "MAX_REPEAT":
            least, most, inner = value
            out += "".join(_sentence(draw, inner) for _ in range(draw.randint(least, min(most, 9))))
        elif name == "ASSERT":
            out += _sentence(draw, value[1])
        else:
            assert name == "ASSERT_NOT"
    return out


def _places(norm):
    return [(start, end, rule.label, rule.priority) for start, end, rule in op3_licenses.detect(norm)]


def test_every_rule_runs_on_what_it_matches(monkeypatch):
    draw = random.Random(2)
    norms = []
    for rule in op3_licenses.rules():
        for _ in range(12):
            norm = op3_licenses.normalise("it is " + _sentence(draw, _parser.parse(rule.pattern.pattern.decode())) + " here")[0]
            assert rule.pattern.search(norm)
            norms.append(norm)
    gated = [_places(norm) for norm in norms]
    open_rules = tuple(rule._replace(keywords=(b" ",), phrase=b" ") for rule in op3_licenses.rules())
    monkeypatch.setattr(op3_licenses, "rules", lambda: open_rules)
    assert all(gated) and gated == [_places(norm) for norm in norms]


@pytest.mark.parametrize(
    "text, label",
    [("This project is released under Apache 2.0", "apache-2"), ("code is distributed under GPL v3", "gpl-3"), ("Data available under Creative Commons Attribution ShareAlike", "cc-by-sa")],
)
def test_grants_without_the_word_license(text, label):
    assert [rule.label for _, _, rule in op3_licenses.detect(op3_licenses.normalise(text)[0])] == [label]

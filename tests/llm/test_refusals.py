import itertools
import re
from re import _constants as C
from re import _parser

import pytest

from loomscribe.llm import refusals as R


def forms(parsed):
    """Texts of a parsed pattern: every branch, and every repeat at its least count and once more."""
    parts = []
    for op, x in parsed:
        if op is C.LITERAL:
            parts.append([chr(x)])
        elif op is C.AT:
            parts.append([""])
        elif op is C.SUBPATTERN:
            parts.append(list(forms(x[3])))
        elif op is C.BRANCH:
            parts.append([t for b in x[1] for t in forms(b)])
        elif op is C.IN:
            parts.append([" "] if x[0][0] is C.NEGATE else ["x"] if x[0][0] is C.CATEGORY else [chr(v) for _, v in x])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            parts.append([t * n for n in (x[0], x[0] + 1) for t in forms(x[2])])
        else:
            raise AssertionError(op)
    return list(dict.fromkeys("".join(t) for t in itertools.product(*parts)))


@pytest.mark.parametrize("pattern", R._EN + R._DE + R._FR + R._ES)
def test_every_form_has_a_mark(pattern):
    got = [t for t in forms(_parser.parse(pattern.replace(R._TASK, "(?:rewrit|do)"))) if re.fullmatch(pattern, t, re.I)]
    assert got
    lost = [t for t in got if not any(m in t.lower() for m in R._MARKS)]
    assert not lost, lost[:5]


def test_first_person_at_the_start():
    yes = ["Ich werde den Beitrag nicht umformulieren.", "Ich möchte den Text nicht überarbeiten.", "As an AI assistant, I must leave the post as it stands.", "Este tarea queda fuera de lo que hago."]
    assert all(map(R.is_refusal, yes)), [t for t in yes if not R.is_refusal(t)]
    assert not R.is_refusal("Ich werde den Beitrag umformulieren.")

"""Spans that are long, or stand where windows end."""

import re

import numpy as np
import pytest

from tableprobe.llm.personal_data import KINDS, added_spans, training_windows
from tableprobe.llm.tagger import PAD, Tagger, codes

FAR = "plain words without any signs stand here and go on for a while " * 3


class Exact:
    """Tags a spaced e-mail as far as the window shows it, like a tagger without mistakes."""

    def tag(self, x):
        out = np.where(x == PAD, -1, 0)
        for row, tags in zip(x, out):
            text = "".join(chars.get(c, "x") for c in row.tolist() if c != PAD)
            for m in re.finditer(r"[\w.]+ @ [\w.-]+", text):
                tags[m.start() : m.end()] = 1
        return out


chars = {int(c): ch for ch in map(chr, range(32, 127)) for c in codes(ch)}


def found(text, tagger):
    return [text[s:e] for _, s, e in added_spans([text], [[]], tagger)[0]]


@pytest.mark.parametrize("local", ["anna", "christopher.montgomery", "a.very.long.name.of.a.whole.department"])
@pytest.mark.parametrize("host", ["example.com", "mail.research.long-institute-name.example.org"])
@pytest.mark.parametrize("before", ["", "7 ", "see 12 and then ", "at 10 there are words up to "])
def test_spaced_mail_of_any_length(local, host, before):
    mail = f"{local} @ {host}"
    for text in (f"{FAR}{before}{mail} {FAR}", f"{before}{mail}", f"{before}{mail} {FAR}5 {mail}"):
        assert found(text, Exact()) == [mail] * text.count(mail), text


def test_a_trained_tagger_finds_a_long_name():
    tagger = Tagger(len(KINDS) + 1, seed=7)
    tagger.fit(*training_windows([FAR[k : k + 60] for k in range(0, 120, 10)], 2400, 7), epochs=8, seed=7)
    for mail in ("christopher.montgomery @ example.com", "christopher.montgomery @ mail.research.long-institute-name.example.org"):
        assert found(f"{FAR}{mail} {FAR}", tagger) == [mail]


def test_reading_goes_on_while_a_span_reaches_the_edge():
    class Letters:
        def tag(self, x):
            return np.where(x == PAD, -1, np.isin(x, codes("@.z ")).astype(np.int64))

    mail = "z" * 90 + " @ " + "z" * 90 + ".zz"
    assert found(f"{FAR}, {mail}, {FAR}", Letters()) == [mail]

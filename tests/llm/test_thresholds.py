"""Thresholds by language and length, and what they keep, against a plain version; orders up to six."""

import math

import numpy as np
import pytest

from tessera.llm import perplexity
from tests.llm.test_operators import docs, kneser_ney, labels, texts  # noqa: F401


@pytest.mark.parametrize("order", [2, 5, 6])
def test_orders(docs, labels, order):  # noqa: F811
    p = kneser_ney([t for i, t in enumerate(texts()) if i % 2 and t], order)
    got = {r.doc_id: r for r in perplexity.quality(docs, labels, order=order).collect()}
    for i, t in enumerate(texts()):
        if t and len(t) < 3000:
            b = b"\n" * (order - 1) + t.encode()
            logs = [np.log(p(b[k : k + order])) for k in range(len(b) - order + 1)]
            assert got[i].perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=2e-3)


def test_thresholds_of_languages_and_lengths(docs, labels, monkeypatch):  # noqa: F811
    monkeypatch.setattr(perplexity, "LEAST_TRUSTED", 2)
    monkeypatch.setattr(perplexity, "LEAST_IN_BAND", 2)
    rows = perplexity.quality(docs, labels).collect()
    band = lambda r: math.floor(math.log2(max(r.n_bytes, 1)) / 2)
    trusted = [r for r in rows if r.doc_id % 2 and r.perplexity is not None]

    def edges(own):
        values = sorted(r.perplexity for r in own)
        return [values[max(0, math.ceil(q * len(values)) - 1)] for q in (perplexity.LOW, perplexity.HIGH)]

    kinds = set()
    for r in rows:
        narrow = [x for x in trusted if (x.lang, band(x)) == (r.lang, band(r))]
        own = [x for x in trusted if x.lang == r.lang]
        use = narrow if len(narrow) >= 2 else own if len(own) >= 2 else trusted
        kinds.add(tuple(sorted(x.doc_id for x in use)))
        low, high = edges(use)
        assert r.low == pytest.approx(low * (1 - perplexity.MARGIN)) and r.high == pytest.approx(high * (1 + perplexity.MARGIN))
        assert r.kept == (r.n_bytes > 0 and r.low <= r.perplexity <= r.high)
    assert len(kinds) > 3

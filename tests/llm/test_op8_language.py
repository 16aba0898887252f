"""Language identification: held-out accuracy and edges."""

import math
import zlib

import pytest
from conftest import SF

from keyloom.llm import language_id, queries
from keyloom.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").select("doc_id", "lang").collect()}
    got = queries.op8_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture(spark):
    docs = table(spark, SF, "documents")
    model = language_id.train(docs)
    by = {}
    for r in docs.filter("lang IN ('en', 'de') AND length(text) > 2000").collect():
        by.setdefault(r["lang"], r["text"][:2000])
    pred, score, mix = model.infer(by["en"] + " " + by["de"][:1000])
    assert pred == "en" and {x for x, _ in mix} == {"en", "de"} and 0.5 < score < 0.85
    assert abs(sum(s for _, s in mix) - 1) < 1e-6


def test_edges(spark):
    docs = table(spark, SF, "documents")
    model = language_id.train(docs)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 ... 456", "x"), (4, "the and", None), (None, "la que de " * 40_000, "es"), (4, "the and", None), (5, "日本語", "x")]
    df = spark.createDataFrame([(*r, "old", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language_id.identify(df, model).collect()
    assert len(got) == 7 and sum(r["lang_pred"] == "und" for r in got) == 3 and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language_id.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language_id.learn_and_identify(df.limit(0).unionByName(df.limit(2))).collect()} == {"und"}
    assert model.infer("\u00bd \u00b2 \u2167 12")[0] == "und" and model.infer("\u00e9")[0] != "und"  # numerals are no letters
    clash = language_id.keep_identified(docs.selectExpr("*", "doc_id AS score", "'x' AS lang_pred")).filter("score <=> doc_id AND lang_pred = 'x'")
    assert clash.count() >= docs.count() - 5 and clash.columns == [*docs.columns, "score", "lang_pred"]
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= docs.count() - 5


class Plain:
    """The mixture model with dictionaries: trigrams of bytes, one proportion at a time."""

    def __init__(self, rows):
        self.n = {}
        for lang, text in rows:
            own = self.n.setdefault(lang, {})
            for b, k in self.trigrams(text).items():
                own[b] = own.get(b, 0) + k
        self.total = {x: sum(own.values()) + language_id.SMOOTHING * language_id.BUCKETS for x, own in self.n.items()}

    @staticmethod
    def trigrams(text):
        raw = "".join(f" {text} ".lower()).encode()
        b = [x if x >= 128 or 97 <= x <= 122 else 32 for x in raw]
        b = [x for i, x in enumerate(b) if not (x == 32 and i and b[i - 1] == 32)]
        out = {}
        for x, y, z in zip(b, b[1:], b[2:]):
            at = ((x << 16 | y << 8 | z) * 2654435761 & 0xFFFFFFFF) >> 18
            out[at] = out.get(at, 0) + 1
        return out

    def infer(self, text):
        t = self.trigrams(text or "")
        if not any(c.isalpha() for c in text or "") or not t:
            return "und", 0.0
        p = {x: {b: (self.n[x].get(b, 0) + language_id.SMOOTHING) / self.total[x] for b in t} for x in self.n}
        like = lambda share: sum(k * math.log(sum(s * p[x][b] for x, s in share.items())) for b, k in t.items())
        total = sum(t.values())
        share = {max(sorted(self.n), key=lambda x: like({x: 1.0})): 1.0}
        best = like(share)
        while len(share) < min(language_id.MAX_LANGUAGES, len(self.n)):
            rise = {x: sum(k * p[x][b] / sum(s * p[y][b] for y, s in share.items()) for b, k in t.items()) / total - 1 for x in sorted(self.n) if x not in share}
            new = max(rise, key=rise.get)
            if rise[new] <= 1e-9:
                break
            now = {**{x: s * 0.8 for x, s in share.items()}, new: 0.2}
            for _ in range(language_id.ROUNDS):
                mixed = {b: sum(s * p[x][b] for x, s in now.items()) for b in t}
                after = {x: s * sum(k * p[x][b] / mixed[b] for b, k in t.items()) / total for x, s in now.items()}
                done = max(abs(after[x] - now[x]) for x in now) < 1e-4
                now = after
                if done:
                    break
            if (got := like(now)) - best <= 0.5 * math.log(total):
                break
            share, best = now, got
        first = max(share, key=share.get)
        return first, min(1.0, share[first])


def test_against_a_plain_model(spark):
    docs = table(spark, SF, "documents").collect()
    rows = [(r["lang"], r["text"]) for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None]
    plain = Plain(rows)
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs}
    mixed = [f"{a['text'][:900]} {b['text'][:700]}" for a, b in zip(docs[::5], docs[1::7]) if a["text"] and b["text"]]
    model = language_id.train(table(spark, SF, "documents").filter(~language_id.held_out()))
    for text, (lang, score) in [*((texts[i], (r["lang_pred"], r["score"])) for i, r in got.items()), *((t, model.infer(t)[:2]) for t in mixed)]:
        want = plain.infer(text)
        assert (lang, round(score, 5)) == (want[0], round(want[1], 5)), text


def test_sample_is_drawn_by_language(spark):
    rows = [(i, f"the and of {i}", "en") for i in range(3000)] + [(9000 + i, f"und der die {i}", "xx") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.train(df, max_rows=50).languages == ["en", "xx"]
    many = spark.range(40).selectExpr("id AS doc_id", "'text' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        language_id.train(many, most_languages=39)
    assert len(language_id.train(many, most_languages=40).languages) == 40


def test_bounded_sample(spark):
    docs = table(spark, SF, "documents")
    model = language_id.train(docs, max_rows=100)
    assert set(model.languages) <= {"en", "de", "fr", "es"} and len(model.languages) >= 3

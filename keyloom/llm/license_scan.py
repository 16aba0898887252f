"""License scans through a positional index of rare licence words. DataFrame functions only.

A template is the words of a licence notice, with a key phrase that must stand complete. The inverse document
frequency of every template word is counted over all texts first. The index then has, for each template, the
rarest words of its key phrase and their positions. A file's occurrences of these words are looked up, and
the postings of a template's words are intersected by relative position: a file position less the template
position is the same for all words of a copy. Where the words meet, the key phrase is verified word by
word, and the template's words in place must carry enough of its weight. As a key phrase stands complete only where its
rarest words stand, no place is lost, however common the other words are.

All of this is done within the row of a text: beyond counting the words nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed values of the contract: phrase and label.
BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Licence notices that this method adds: label, text, mandatory key phrase (which stands in the text).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("apache-grant", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed on an as is basis"),
)
#: The share of a template's weight that a place needs, and the words of a key phrase that are looked up.
COVERAGE, RARE = 0.6, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but letters and digits.
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def posting_rows() -> list[tuple]:
    """(template, kind, label, word, tpos, key) of every template word."""
    rows = []
    for phrase, label in BASE_PHRASES:
        rows += [(f"base:{label}", "base", label, w, k, True) for k, w in enumerate(phrase.split())]
    for label, text, key in TEMPLATES:
        words, k = text.split(), text.split().index(key.split()[0])
        while words[k : k + len(key.split())] != key.split():
            k = words.index(key.split()[0], k + 1)
        rows += [(f"method:{label}", "method", label, w, i, k <= i < k + len(key.split())) for i, w in enumerate(words)]
    return rows


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): the words of each text; ASCII capitals are lowered and no other letter is."""
    spaced = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER + _BETWEEN, _LOWER + " " * len(_BETWEEN))
    return docs.select(F.col(id_col).alias("id"), F.array_remove(F.split(spaced, " "), "").alias("w"))


def _text(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def word_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """The inverse document frequency of every template word over all texts; as many rows come to the driver as the templates have words."""
    vocabulary = sorted({r[3] for r in posting_rows()})
    held = _words(docs, id_col, text_col).select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(F.expr(_text(vocabulary)), "w"))).alias("word"))
    # The empty word stands in every text and counts them.
    seen = {r["word"]: r["df"] for r in held.groupBy("word").agg(F.count("*").alias("df")).collect()}
    spark, n = docs.sparkSession, seen.get("", 0)
    rows = spark.createDataFrame([(w, seen.get(w, 0)) for w in vocabulary], "word string, df long")
    return {r["word"]: r["weight"] for r in rows.select("word", F.round(F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)), 6).alias("weight")).collect()}


def index_of(weights: dict[str, float], rare: int = RARE) -> tuple[str, list[str]]:
    """The index as a SQL array of templates, and the words that are looked up in it."""
    templates, looked = {}, set()
    for template, kind, label, word, tpos, key in posting_rows():
        templates.setdefault((template, kind, label), []).append((word, tpos, key))
    told = []
    for (_, kind, label), words in templates.items():
        first = {}
        for w, at, key in words:
            if key:
                first.setdefault(w, at)
        rarest = sorted(first, key=lambda w: (-weights[w], w))[:rare]
        looked |= set(rarest)
        lookups = "array(" + ", ".join(f"named_struct('word', '{w}', 'at', {first[w]})" for w in rarest) + ")"
        own = "array(" + ", ".join(f"{weights[w]!r}D" for w, _, _ in words) + ")"
        told.append(
            f"named_struct('base', {str(kind == 'base').lower()}, 'label', '{label}', 'rare', {lookups}, 'from', {min(at for _, at, key in words if key)}, 'key', {_text([w for w, _, key in words if key])}, "
            f"'words', {_text([w for w, _, _ in words])}, 'weights', {own}, 'weight', {sum(weights[w] for w, _, _ in words)!r}D)"
        )
    return f"array({', '.join(told)})", sorted(looked)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, rare: int = RARE) -> DataFrame:
    """A row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template's weight found in place, 0 without a label and 1 for a
    base phrase. Null and empty texts have no words. Repeated rows come out repeated. Only the two named
    columns are read. An empty table gives an empty result.
    """
    templates, looked = index_of(word_weights(docs, id_col, text_col), rare)
    hits = _words(docs, id_col, text_col).select("id", "w", F.expr(f"filter(transform(w, (x, i) -> if(x IN ({', '.join(repr(w) for w in looked)}), i, -1)), i -> i >= 0)").alias("hits"))
    # Where a template's looked-up words meet: the starts that all of them ask for.
    starts = "transform(t.rare, r -> transform(filter(hits, p -> w[p] = r.word), p -> p - r.at))"
    meet = f"aggregate({starts}, cast(null as array<int>), (a, b) -> if(a is null, b, array_intersect(a, b)))"
    whole = f"filter({meet}, s -> s + t.from >= 0 and slice(w, s + t.from + 1, size(t.key)) = t.key)"
    share = "if(t.base or t.weight = 0, 1D, round(aggregate(sequence(0, size(t.words) - 1), 0D, (a, i) -> a + if(get(w, s + i) <=> t.words[i], t.weights[i], 0D)) / t.weight, 6))"
    places = f"flatten(transform({templates}, t -> transform({whole}, s -> named_struct('base', t.base, 'label', t.label, 'start', cast(s as bigint), 'share', {share}))))"
    met = hits.select("id", F.size("w").cast("long").alias("n_words"), F.expr(f"if(size(hits) = 0, null, filter({places}, f -> f.base or f.share >= {coverage}D))").alias("met"))
    base = "transform(filter(met, f -> f.base), f -> f.{})"
    labels = "coalesce(array_join(sort_array(array_distinct({})), ','), '')"
    return met.select(
        F.col("id").alias(id_col), "n_words", F.expr("coalesce(size(filter(met, f -> f.base)), 0)").cast("long").alias("n_base"), F.expr(f"array_min({base.format('start')})").alias("first_word"),
        F.expr(f"array_max({base.format('start')})").alias("last_word"), F.expr(labels.format(base.format("label"))).alias("base_labels"), F.expr(labels.format("transform(met, f -> f.label)")).alias("labels"),
        F.expr("coalesce(array_max(transform(met, f -> f.share)), 0D)").alias("score"),
    )

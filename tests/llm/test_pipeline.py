"""The stages of the corpus pipeline, and the run of all, against brute force; with repeated and null ids."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from traceloom.llm import op2_toxicity, op4_near_dedup

FORM = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANK = " \t\n\x0b\x0c\r"


def _groups(sets):
    """The number of the component of each set, linked at a Jaccard similarity of 0.75."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def _words(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _one_of_each(rows):
    sets = [_words(r.text) for r in rows]
    groups, least = _groups(sets), {}
    for r, g in zip(rows, groups, strict=True):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    return collections.Counter(r for r, s, g in zip(rows, sets, groups, strict=True) if not s or r.doc_id == least.get(g))


def _without_repeats(rows):
    """Rows of distinct ids; of similar lines the first by id (null last) and place stays."""
    places, lines = [], []
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        for i, line in enumerate((r.text or "").split("\n")):
            if line.strip(BLANK):
                places.append((r.doc_id, i))
                lines.append(line.strip(BLANK))
    first, gone = {}, set()
    for place, g in zip(places, _groups([frozenset(x[i : i + 9] for i in range(max(1, len(x) - 8))) for x in lines]), strict=True):
        if first.setdefault(g, place) != place and place[0] is not None:
            gone.add(place)
    out = collections.Counter()
    for r in rows:
        dropped = [i for d, i in gone if d == r.doc_id]
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in dropped) if dropped else r.text
        if not dropped or text.strip(BLANK):
            out[(r.doc_id, text, r.source, len(text) if dropped else r.n_chars)] += 1
    return out


def _docs():
    draw = random.Random(21)
    rows = []
    for i in range(90):
        lines = [" ".join(f"w{draw.randrange(500)}" for _ in range(12)) for _ in range(5)]
        if i % 6 == 0:
            lines[0] = "moron scum loser " + lines[0]
        if i % 9 == 1:
            lines[1:] = [*rows[-1][1].split("\n")[1:4], lines[4]]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
    rows += [(90, None, "en", "s0", 0), (91, " ", "en", None, 0), (None, "a text that has no id at all", "en", "s1", 0)]
    return [(*r[:4], len(r[1] or "")) for r in rows]


def test_rows_go_by_id_and_text(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (2, "a clean text under the same id as the near copy"), (None, "one " + text), (None, "no copy of anything here"), (None, None), (4, ""), (4, text)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], FORM)
    assert collections.Counter(op4_near_dedup.one_of_each(docs).collect()) == _one_of_each(docs.collect())
    assert {(r.doc_id, r.text) for r in op4_near_dedup.one_of_each(docs).collect()} == {rows[i] for i in (0, 2, 4, 5, 6)}


def test_stages_and_run(spark, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    rows, folder = _docs(), str(tmp_path)
    spark.createDataFrame(rows, FORM).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(90)], "doc_id bigint, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, FORM).cache()

    model = op2_toxicity.fit(docs, labels)
    clean = stages["toxicity"](spark, docs, folder).cache()
    assert collections.Counter(clean.collect()) == collections.Counter(r for r in docs.collect() if model.score(r.text) < 0.5)
    lines = stages["line_dedup"](spark, clean, folder).cache()
    assert collections.Counter((r.doc_id, r.text, r.source, r.n_chars) for r in lines.collect()) == _without_repeats(clean.collect())
    once = stages["near_dedup"](spark, lines, folder).cache()
    assert collections.Counter(once.collect()) == _one_of_each(lines.collect())
    mixed = stages["mixing"](spark, once, folder).cache()
    taken, had = collections.Counter(mixed.collect()), collections.Counter(once.collect())
    assert set(taken) <= set(had) and all(n <= 3 * had[r] for r, n in taken.items())

    codec = Tokenizer.from_file(path)
    expected = collections.Counter()
    for r in mixed.collect():
        ids = codec.encode(r.text or "", add_special_tokens=False).ids
        expected[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == expected

"""The pipeline against a plain version of its five stages, on a corpus with all edge cases."""

import random
import re
from collections import Counter

import pytest
from test_llm_operators import base, overlaps
from texts import SCHEMA, classes, prose, sentences, words

import corpus_pipeline
from tessella.llm import sentencepiece
from tessella.llm.quality_rules import BOILERPLATE

BENCHMARK = "item_id long, text string"
PHRASE = re.compile(r"(?<![^\W_])(?:" + "|".join(BOILERPLATE) + r")(?![^\W_])", re.IGNORECASE)
SECRET = re.compile(r"token = (value\d{4}x)")


def bad_line(line):
    w = words(line)
    n, separators = len(w), sum(bool(re.fullmatch("[|»›•·]+", x)) for x in w)
    symbols, shouts = len(re.findall(r"[#*$%&|<>~^{}]", line)), sum(x.endswith("!!") for x in w)
    return bool(
        separators and n - separators <= 4 * separators
        or symbols > 0.1 * sum(map(len, w))
        or shouts > 1 and shouts > 0.3 * n
        or n >= 3 and not re.search("[.!?:;,…。]", line)
        or n <= 20 and PHRASE.search(line)
    )


def plain_pipeline(rows, items):
    """(doc_id, lang, source, n_chars, text) of the rows that all stages keep."""
    clean = []
    for i, text, lang, source, _ in rows:
        n_words, _, _, _, repeated = base(text)
        lines = (text or "").split("\n")
        lost = sum(len(words(x)) for x in lines if bad_line(x))
        if n_words >= 50 and 100 * repeated <= 50 * n_words and lost <= 0.5 * n_words:
            clean.append((i, "\n".join(x for x in lines if not bad_line(x)), lang, source))
    _, part = classes(clean)
    kept = {}
    for r, p in sorted(zip(clean, part), key=lambda x: (x[0][0] is None, x[0][0])):
        kept.setdefault(p, r)
    dirty = {k[0] for k in overlaps([(n, r[1]) for n, r in enumerate(kept.values())], items)}
    kept = [r for n, r in enumerate(kept.values()) if n not in dirty]
    held: dict = {}
    for _, text, _, source in kept:
        for v in SECRET.findall(text):
            held.setdefault(v, set()).add(source or "")
    live = {v for v, sources in held.items() if len(sources) < 3}
    out = []
    for i, text, lang, source in kept:
        text = SECRET.sub(lambda m: "[SECRET]" if m[1] in live else m[0], text)
        out.append((i, lang, source, len(text), text))
    return out, live


def messy_corpus(seed):
    rng = random.Random(seed)
    items = [(n, prose(rng, 15)) for n in range(4)]
    texts = [sentences(rng, rng.randint(6, 12)) for _ in range(24)]
    texts += [texts[0], texts[1] + "\nAll rights reserved.", texts[2] + "\nHome | News | About | Contact", texts[3].replace("\n", "\n\n")]
    for i in (4, 4, 5):  # a word changed
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for _, item in items[:3]:  # whole, in capitals, with three words changed, with four
        w = item.split()
        texts.append(f"{sentences(rng, 6)}\nIt says: {item.upper()}.\n{sentences(rng, 2)}")
        for n in (3, 4):
            gone = set(rng.sample(range(15), n))
            texts.append(f"{sentences(rng, 6)}\nIt says: {' '.join('zzz' if k in gone else x for k, x in enumerate(w))}.")
    texts += [f"{sentences(rng, 7)}\nThe token = value{n % 6:04d}x was left." for n in range(15)]
    texts += [texts[-1], texts[-2] + " Said again.", f"{sentences(rng, 3)}\nThe token = value0009x was left."]
    texts += [sentences(rng, 5) + "\n" + "\n".join("aa | bb | cc | dd | ee" for _ in range(40)), "same same " * 60 + ".", sentences(rng, 900)]
    texts += ["", None, "short text.", " \n\t "]
    rows = [(i, t, rng.choice(["en", "de", None]), f"s{rng.randrange(5)}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], (None, texts[7], None, None, None), (None, sentences(rng, 8), None, None, None), (None, None, None, None, None)]
    rng.shuffle(rows)
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_pipeline_equals_a_plain_version(spark, tmp_path, seed):
    import sentencepiece as library

    rows, items = messy_corpus(seed)
    want, live = plain_pipeline(rows, items)
    assert 0 < len(live) < 7 and 30 < len(want) < len(rows) - 10
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items + [(9, None), (10, "")], BENCHMARK).write.parquet(f"{tmp_path}/benchmark.parquet")
    sp = library.SentencePieceProcessor(model_file=sentencepiece.DEFAULT_MODEL)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, *r.ids) for r in got) == Counter((*r[:4], *sp.encode(r[4])) for r in want)
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in got)


CLASHES = ("key", "row", "kept", "body", "judged", "text_key", "set_key", "spans", "found", "hits", "live", "n_words")


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    rows, items = messy_corpus(3)
    clashing = SCHEMA + "".join(f", {c} string" for c in CLASHES)
    full = spark.createDataFrame([(*r, *CLASHES) for r in rows], clashing)
    for name, documents, bench in (("full", full, items), ("no_benchmark", full, []), ("none", full.limit(0), items)):
        at = f"{tmp_path}/{name}"
        documents.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(bench, BENCHMARK).write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, at)
            assert docs.columns == full.columns, stage
        want = plain_pipeline(rows, bench)[0] if name != "none" else []
        got = docs.collect()
        assert Counter((r.doc_id, r.n_chars, r.text) for r in got) == Counter((r[0], r[3], r[4]) for r in want), name
        assert all(r[c] == c for r in got for c in CLASHES)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == len(want)

"""The pipeline against plain versions of its stages, on documents that try every stage."""

import collections
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from voxelframe.llm import mixing, quality_rules
from voxelframe.llm.queries import tokenizer_path

from test_mixing import plain_targets  # tests/llm is on the path: it is no package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, rate double, key long, keys long"
REST = ("g", 0.5, 1, 2)


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    again = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again), "n_lines": len(lines), "n_stop_words": sum(x.lower() in quality_rules.STOP_WORDS for x in w), "n_loud": t.count("!"),
    }


def good(text):
    c = counts(text)
    if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
        return False
    ratios = {"mean_word_chars": c["word_chars"] / c["n_words"], "symbol_share": c["n_symbols"] / c["n_words"], "stop_share": c["n_stop_words"] / c["n_words"], "dup_line_share": c["n_dup_lines"] / c["n_lines"], "loud_share": c["n_loud"] / c["n_words"]}
    return all((r.low is None or ratios[r.name] >= r.low) and (r.high is None or ratios[r.name] <= r.high) for r in quality_rules.RULES)


def deduped(rows):
    """Rows with the lines taken out that later occurrences of three-line windows cover. Ids that repeat hold equal texts here."""
    first, gone = {}, collections.defaultdict(set)
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        lines = [(k, x) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
        for at in range(len(lines) - 2):
            win = tuple(x for _, x in lines[at : at + 3])
            if win not in first:
                first[win] = (i, at)
                continue
            for k in range(at, at + 3):
                if not (first[win][0] == i and k < first[win][1] + 3):
                    gone[i].add(lines[k][0])
    out = []
    for r in rows:
        t = r[1] if r[0] is None or r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[0]])
        if t == r[1] or WORD.search(t):
            out.append((r[0], t, r[2], r[3], len(t), *r[5:]))
    return out


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return [r for r in rows if r[0] is None or comp[r[0]] == r[0]]


def mixed(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    target, out = plain_targets(sizes), []
    for r in rows:
        rate = round(target[r[3]], 6) / sizes[r[3]]
        key = str(r[0]) if r[0] is not None else hashlib.md5(r[1].encode()).hexdigest()
        u = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [r] * (int(rate) + (u < rate - int(rate)))
    return out


def documents():
    rng = np.random.default_rng(21)
    stop = ["the", "of", "and", "to", "in"]

    def line(n=9):
        return " ".join(stop[int(rng.integers(0, 5))] if rng.random() < 0.3 else f"word{k}" for k in rng.integers(0, 900, n))

    def text(n):
        return "\n".join(line() for _ in range(n))

    shared, one = text(4), text(5).replace("\n", " ") + "\n" + text(6).replace("\n", " ")
    texts = [None, "", " \n\t", "too short", "z " * 200, "a !!!!! ### " * 60, text(900)]
    texts += [text(int(n)) for n in rng.integers(8, 20, 25)]
    texts += [text(8) + "\n" + shared + "\n" + text(3), shared + "\n\n" + text(9), text(9) + "\n" + shared.upper()]
    texts += [one.replace("word", w, 1) for w in ("word", "other", "more", "word", "final")]  # two lines each: left to the join of near copies
    same = text(12)
    texts += [same, same]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], 7, *REST) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, text(10), "en", "a", 1, *REST), (None, one, None, None, 1, *REST)]
    return rows


@pytest.mark.parametrize("nothing", [False, True])
def test_stages_equal_plain_ones(spark, tmp_path, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    rows = [] if nothing else documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = rows
    steps = [lambda x: [r for r in x if good(r[1])], deduped, one_of_each, mixed]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps):
        got, plain = stage(spark, docs, str(tmp_path)), step(plain)
        assert got.columns == docs.columns
        assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(plain), name
        if not nothing:
            assert plain
        got.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for r in plain:
        ids = t.encode(r[1], add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids))] += 1
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in out.collect()) == want


def test_near_copies_of_few_lines_go(spark):
    """Recall of the near-copy stage on its own input: every planted near copy that the plain join finds goes."""
    rows = [r for r in documents() if good(r[1])]
    before = deduped(rows)
    stay = {r[0] for r in one_of_each(before)}
    df = spark.createDataFrame(before, SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert got == stay and len({r[0] for r in before}) - len(stay) >= 4

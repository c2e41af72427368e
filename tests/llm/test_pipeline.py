"""The language predictions and the whole corpus pipeline against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import language, mixing, near, packing
from lectern.session import checkpointed
from tests.llm.test_dedup import bag, jaccard

MASK = 2**64 - 1


def positions(gram):
    h = len(gram)
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & MASK
    h = int(language.mix(np.array([h], np.uint64))[0])
    return [((h & 0xFFFFFFFF) + k * ((h >> 32) | 1) & MASK) % language.POSITIONS for k in range(language.HASHES)]


def text_grams(text):
    """All n-grams of a text, one by one."""
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    padded = f" {letters} " if letters else " "
    return [padded[i : i + n] for n in language.SIZES for i in range(len(padded) - n + 1)]


class PlainFilters:
    """One set of positions per language, learned from ``(text, lang)`` without a bit mask."""

    def __init__(self, rows):
        self.size = Counter(lang for _, lang in rows)
        self.held = {lang: Counter() for lang in self.size}
        for text, lang in rows:
            self.held[lang].update(set(text_grams(text)))
        self.set, self.usual = {}, {}
        for lang, held in self.held.items():
            least = max(1.0, min(2.0, self.size[lang]), language.LEAST_SHARE * self.size[lang])
            self.set[lang] = {p for g, n in held.items() if n >= least for p in positions(g)}
            self.usual[lang] = sum(n for n in held.values() if n - 1 >= least) / sum(held.values())
        self.rate = {lang: (len(s) / language.POSITIONS) ** language.HASHES for lang, s in self.set.items()}

    def guess(self, text):
        """``(lang, score, share, grams)`` of a text."""
        found = text_grams(text or "")
        if not any(c.isalpha() for c in text or "") or not self.set:
            return "und", 0.0, 0.0, len(found)
        places = [positions(g) for g in found]
        counts = {}
        for lang in sorted(self.set):
            hits = sum(all(p in self.set[lang] for p in at) for at in places)
            counts[lang] = max(0.0, (hits - len(found) * self.rate[lang]) / max(1e-9, 1 - self.rate[lang]))
        best = max(sorted(counts), key=lambda lang: counts[lang])
        top, total = counts[best], sum(counts.values())
        share = top / (len(found) * self.usual[best]) if self.usual[best] > 0 else 1.0
        if not top:
            best = max(self.size, key=lambda lang: (self.size[lang], lang))
        return best, top / total if total else 0.0, share, len(found)


WORDS = {
    "en": "the river and a house of this old town with every green tree near water where people live under bright skies",
    "de": "der fluss und ein haus dieser alten stadt mit jedem baum neben wasser wo viele menschen leben unter hellem himmel",
    "es": "el lago con una casa de esta vieja ciudad donde cada arbol verde junto al agua vive mucha gente bajo cielos claros",
}


def corpus():
    """Texts of three languages, exact and near copies, and texts that are in no language."""
    rng = np.random.default_rng(4)
    texts = []
    for lang, words in WORDS.items():
        for _ in range(30):
            texts.append((" ".join(rng.choice(words.split(), 40 + int(rng.integers(30)))), lang))
    copies = [texts[i] for i in (0, 0, 31, 62)]
    close = [(f"{texts[i][0]} end", texts[i][1]) for i in (5, 40, 70)]
    strange = [("12 34 56 !!", "en"), ("", "de"), (None, "es"), ("жук зря щипал чай эхом фраз цвета", None), ("ЖЩ" * 60, None)]
    rows = [(t, lang, f"s{i % 5}" if i % 3 else "s0") for i, (t, lang) in enumerate(texts + copies + close + strange)]
    return [(i, t, lang, source) for i, (t, lang, source) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "documents.parquet")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def learned():
    return PlainFilters([(t, lang) for i, t, lang, _ in corpus() if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1])


def test_languages_against_plain_sets(docs):
    plain = learned()
    got = {r.doc_id: r for r in language.predict(docs, language.fit(language.learning_rows(docs))).collect()}
    assert len(got) == len(corpus())
    for i, text, _, _ in corpus():
        lang, score, share, grams = plain.guess(text)
        r = got[i]
        assert (r.lang_pred, r.grams) == (lang, grams), (i, text)
        assert abs(r.score - score) < 1e-9 and (lang == "und" or abs(r.share - share) < 1e-9)


def test_pipeline_against_plain_python(spark, docs):
    kept = {i: (t, source) for i, t, _, source in corpus()}
    plain = learned()
    for i, (text, _) in list(kept.items()):
        lang, _, share, grams = plain.guess(text)
        if lang == "und" or share < 0.5 - 3 * (language.ALIKE * 0.25 / max(1, grams)) ** 0.5:
            del kept[i]
    stage = iter(corpus_pipeline.STAGES)

    def step(before):
        return checkpointed(next(stage)[1](spark, before, ""))

    out = step(docs)
    assert {r.doc_id for r in out.collect()} == set(kept)
    assert len(corpus()) - len(kept) == 5

    last = {text: i for i, (text, _) in sorted(kept.items())}
    kept = {i: kept[i] for i in last.values()}
    out = step(out)
    assert {r.doc_id for r in out.collect()} == set(kept)

    bags, parent = {i: bag(t) for i, (t, _) in kept.items()}, {i: i for i in kept}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and jaccard(bags[a], bags[b]) >= near.SIMILARITY:
                parent[min(top(a), top(b))] = max(top(a), top(b))
    kept = {i: v for i, v in kept.items() if top(i) == i}
    out = step(out)
    assert {r.doc_id for r in out.collect()} == set(kept)

    # The mix: whole epochs, then the least keys up to the budget, the last text cut after a word.
    key = {r.doc_id: r.key for r in mixing.sized(out).collect()}
    size = {i: len(t.split()) for i, (t, _) in kept.items()}
    by = defaultdict(list)
    for i, (_, source) in kept.items():
        by[source].append(i)
    names = sorted(by)
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    goal, open_, left = {}, set(names), mixing.SHARE * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > mixing.EPOCHS * total[s]}
        for s in over or open_:
            goal[s] = mixing.EPOCHS * total[s] if over else weight[s] * level
        left -= sum(goal[s] for s in over)
        open_ = open_ - over if over else set()
    want = Counter()
    for s in names:
        turns = int(goal[s] / total[s] + 1e-12)
        rest = int(goal[s] + 1e-9) - turns * total[s]
        for i in by[s]:
            want[i, kept[i][0]] += turns
        for i in sorted(by[s], key=lambda i: (key[i], i)):
            part = min(rest, size[i])
            if part > 0:
                want[i, " ".join(kept[i][0].split()[:part])] += 1
            rest -= part
    out = step(out)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want

    # The windows: every id of every text of the mix once, in gapless windows that are full or nearly so.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = Counter()
    for (i, text), n in (+want).items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        coded[i, len(ids), zlib.crc32(ids.tobytes())] += n
    pieces = next(stage)[1](spark, out, "").collect()
    assert all(r.start == 0 and r.length == r.doc_tokens for r in pieces)  # the texts are shorter than a tail
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in pieces) == coded
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    ids = sum(r.length for r in pieces)
    assert len(windows) <= -(-ids // packing.CAPACITY) + 1

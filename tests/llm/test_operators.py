"""Operators against brute force, SQL, the library whose counts they give, or held-out labels."""

import io
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluorite.llm import queries
from fluorite.llm.decontamination import decontaminate
from fluorite.llm.graph import connected_components
from fluorite.llm.jaccard import jaccard_components
from fluorite.llm.licenses import KNOWN, known_licenses, scan_licenses
from fluorite.llm.lines import dedup_lines
from fluorite.llm.mixing import mix_sources
from fluorite.llm.neighbours import SmallWorld, build_shard, link_vectors, search_shard, unit
from fluorite.llm.personal import PATTERNS, find_personal
from fluorite.llm.quality import fit_field, forward_backward, line_features
from fluorite.llm.tokens import TokenCounter
from fluorite.llm.toxicity import Lexicon, folded

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


# --- token counts


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    tokenizer_file = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    return Tokenizer.from_file(tokenizer_file), TokenCounter(*TokenCounter.parameters(tokenizer_file))


ODD_TEXTS = ["", "I'm we're  they'll 's '' 's don't'll", " 's", "'sabc", "\n\n a\n b  \n", "a  ", "a <|endoftext|> b  <|endoftext|>", "'r 're 'rex", "naïve ½ ①x", "a" * 5000, "日本語 x", "x\x00y", "ab" * 3000 + " " + "=-" * 500]


def test_counts_are_the_librarys(both):
    library, ours = both
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice("abst'rvelmd  \n\t.,!1²éß '") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert ours(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(both, text):
    library, ours = both
    assert ours([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_long_pieces_without_an_end(both):
    library, ours = both
    rng = random.Random(2)
    texts = ["x" * 30_001, "ab" * 9_000, "é" * 4_000, "".join(rng.choice("abcdethon") for _ in range(20_000)), "=-" * 7_000, "日本" * 3_000]
    assert ours(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_when_states_are_dropped(both, monkeypatch):
    from fluorite.llm import tokens

    library, ours = both
    monkeypatch.setattr(tokens, "STATES", 10)
    monkeypatch.setattr(tokens, "SLAB", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abst'rvelmd  \n.!1é") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert ours(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_neighbours_against_merging(both):
    """Two tokens stay as they are side by side exactly if merging their bytes by rank gives them back."""
    v = both[1].machine.vocabulary

    def spell(t):
        return [t] if v.parts[t] is None else spell(v.parts[t][0]) + spell(v.parts[t][1])

    def merged(units):
        while True:
            found = [(v.rank[p], i) for i, p in enumerate(zip(units, units[1:], strict=False)) if p in v.rank]
            if not found:
                return units
            token, i = min(found)
            units[i : i + 2] = [token]

    rng = random.Random(5)
    for _ in range(3000):
        x, y = (rng.choice([rng.randrange(256), rng.randrange(2000), rng.randrange(len(v.parts))]) for _ in range(2))
        if merged(spell(x)) == [x] and merged(spell(y)) == [y]:
            assert v.neighbours(x, y) == (merged(spell(x) + spell(y)) == [x, y]), (x, y)


# --- toxicity and quality


def test_folding_and_exceptions():
    lexicon = Lexicon({"idiot": 1.0}, {"idiot proof"})
    a = lexicon.automaton()
    assert folded("1d10t") == "idiot" and folded("ІDIОТ") == "idiot" and len(folded("İx$")) == 3
    assert [h[:2] for h in lexicon.hits("an 1D10T, and idiots", a)] == [(3, 8)]
    assert lexicon.hits("idiot proof", a) == [] and len(lexicon.hits("idiot$$$", a)) == 1


def test_hits_against_plain_search():
    rng = random.Random(6)
    lexicon = Lexicon({"ab": 1.0, "ba": 0.5, "ab ba": 0.7}, {"ab ba ab", "ba ba"})
    a = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(["ab", "ba", "AB", "c", "abba", "4b"]) for _ in range(rng.randint(0, 12)))
        low = folded(text)

        def places(phrases, low=low):
            found = [(m.start(), m.start() + len(p), w) for p, w in phrases for m in re.finditer(f"(?={re.escape(p)})", low)]
            return [f for f in found if (f[0] == 0 or not low[f[0] - 1].isalnum()) and (f[1] == len(low) or not low[f[1]].isalnum())]

        excused = places([(p, 0) for p in lexicon.exceptions])
        want = [h for h in places(lexicon.terms.items()) if not any(e[0] <= h[0] and h[1] <= e[1] for e in excused)]
        assert sorted(lexicon.hits(text, a)) == sorted(want)


def test_a_long_text_with_many_excuses_is_quick():
    import time

    lexicon = Lexicon({"bad": 1.0}, {"bad luck"})
    start = time.time()
    assert len(lexicon.hits("bad luck bad " * 100_000, lexicon.automaton())) == 100_000 and time.time() - start < 10


def test_long_words_and_many_terms_are_learned(spark, docs_of):
    from fluorite.llm.toxicity import train_lexicon

    slur, copied = "z" * 70, "y" * 70
    beside = lambda i: "q" + "ab"[i % 2] * (i + 1)
    rows = [(i, f"plain {beside(i)} {slur} here and the {copied} of one text" if i % 2 else f"plain words more here {i}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    terms = train_lexicon(docs_of(rows), labels).terms
    assert slur in terms and copied not in terms  # what stands between the same words each time counts once


@tables
@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.9), ("op4_line_quality", "quality", 0.85)])
def test_held_out_labels(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    scored = queries.QUERIES[name](spark, sf)
    seen = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(f"held_out and {label} is not null").collect()
    assert all(0 <= r["score"] <= 1 for r in seen)
    assert np.mean([r["predicted"] == r[label] for r in seen]) >= least


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    node, pairs = rng.standard_normal((1, 4)), rng.standard_normal((2, 2))
    log_z, p, expected = forward_backward(node, np.ones((1, 4), bool), pairs)
    every = [[b >> i & 1 for i in range(4)] for b in range(16)]
    weight = np.array([np.exp(sum(node[0, i] * y[i] for i in range(4)) + sum(pairs[y[i], y[i + 1]] for i in range(3))) for y in every])
    assert np.isclose(log_z[0], np.log(weight.sum()))
    assert np.allclose(p[0], [sum(w for w, y in zip(weight, every, strict=True) if y[i]) / weight.sum() for i in range(4)])
    assert np.isclose(expected[1, 1], sum(w * sum(y[i] and y[i + 1] for i in range(3)) for w, y in zip(weight, every, strict=True)) / weight.sum())


def test_scores_in_pieces_against_plain_products(monkeypatch):
    from fluorite.llm import quality

    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["", "a b c", "BUY NOW!!", "x y z w", "%% $$ 12"]) for _ in range(n)).encode() for n in (1, 3, 40, 7, 1, 90)]
    features, length, lines = quality.line_features(texts)
    field = quality.LineField(np.random.default_rng(0).standard_normal(features.shape[1]).astype(np.float32), np.array([[0.4, -0.2], [-0.3, 0.6]]), np.zeros(3))
    whole = features.astype(float) @ field.weights
    monkeypatch.setattr(quality, "PIECE", 8)
    node, own_length, own_lines = field.scores(texts)
    assert np.allclose(node, whole, atol=1e-4) and (length == own_length).all() and (lines == own_lines).all()
    at = 0
    for n, share in zip(lines, field.quality(node, length, lines), strict=True):  # padded batches against texts by themselves
        _, p, _ = forward_backward(whole[None, at : at + n], np.ones((1, n), bool), field.pairs)
        assert np.isclose(share, ((1 - p[0]) * (length[at : at + n] + 1)).sum() / (length[at : at + n] + 1).sum(), atol=1e-5)
        at += n


def test_a_text_of_line_breaks_stays_small():
    import tracemalloc

    from fluorite.llm import quality

    field = quality.LineField(np.zeros(3 * quality.own_features([b""], [True], set())[0].shape[1], np.float32), np.zeros((2, 2)), np.zeros(3))
    tracemalloc.start()
    node, length, lines = field.scores([b"\n" * 400_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(node) == lines[0] == 400_001 and peak < 400 * len(node)


def test_bad_lines_lower_quality():
    rng = random.Random(0)
    line = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone"]) for _ in range(12)) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!", "%%%$$", "###"]) for _ in range(12))
    good = ["\n".join(line() for _ in range(5)) for _ in range(40)]
    bad = ["\n".join([line()] + [junk() for _ in range(4)]) for _ in range(40)]
    field = fit_field([t.encode() for t in good + bad], np.array([True] * 40 + [False] * 40))
    share = field.quality(*field.scores([t.encode() for t in good + bad]))
    assert field.score(share)[:40].min() > 0.5 > field.score(share)[40:].max()


# --- personal data


def brute_spans(text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(digits):
        return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    def valid(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k in plain for m in re.finditer(plain[k], text) if valid(k, m.group())]


def test_base_spans_against_plain_patterns(spark, docs_of):
    rng = random.Random(5)
    texts = ["a@b@c.d x@y..z é@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12", "é" * 5 + " a.b@c.de,f@g.hi"]
    texts += ["".join(rng.choice("a1@.+ -()é49") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in find_personal(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert set(PATTERNS) == {"email", "ip", "card", "phone"}


def test_patterns_find_unseen_identifiers(docs_of):
    rng = random.Random(7)
    seeds = [f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(10, 99)}" for _ in range(60)]
    rows = [(i, f"the log says host {s} refused us") for i, s in enumerate(seeds)]
    shapes = [s for s in seeds if [len(p) for p in s.split(".")] == [3, 3, 3, 2]]
    assert len(shapes) > 10
    rows += [(100, "the log says host 300.301.302.99 refused us"), (101, "version 300.301.302.98 is out")]
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["found"]] for r in find_personal(docs_of(rows)).collect()}
    assert found[100] == [("ip", "300.301.302.99")] and found[101] == []


def test_context_words_of_any_length(docs_of):
    long = "z" * 70
    rows = [(i, f"aaaaaaa{long} {100 + i}.{200 + i % 50}.44.11 x") for i in range(30)]
    rows += [(100, f"aaaaaaa{long} 300.301.44.11 x"), (101, f"bbbbbbb{long} 300.302.44.11 y")]
    found = {r["doc_id"]: [s["value"] for s in r["found"]] for r in find_personal(docs_of(rows), least_patterns=1).collect()}
    assert found[100] == ["300.301.44.11"] and found[101] == []


# --- mixing


def test_mixing_targets(docs_of):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3] if i % 10 else None) for i in range(300)]
    got = mix_sources(docs_of(rows)).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(s for s in sizes if s) + [None]
    weights = dict(zip(names, [5, 2, 1, 5], strict=True))
    total, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: (total - sum(target.values())) * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            open_.discard(s)
    target |= share if open_ else {}
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert np.isclose(mine[0]["target"], target[s]) and mine[0]["source_size"] == sizes[s]
        assert sum(r["taken"] for r in mine) == int(target[s] + 0.5)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs_of(rows[::-1])).collect()))


# --- near duplicates


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [(len(sets[i]), top(i)) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "num", "often", "most"), [(3, 90, 16, 1 << 20), (3, 90, 2, 1 << 20), (5, 80, 4, 1 << 20), (5, 80, 2, 40), (3, 90, 2, 0)])
def test_components_against_all_pairs(docs_of, k, num, often, most):
    rng = random.Random(k * often)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + rng.choice(["", " end"]))
    texts += [" ".join(passage)] * 3 + ["A b", "a  B", "", None]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(list(enumerate(texts))), k=k, num=num, often=often, most_often=most, bucket_bytes=1000).collect()}
    assert got == dict(enumerate(brute_components(texts, k, num, 100)))


def test_components_of_sets_of_unequal_sizes(docs_of):
    rng = random.Random(4)
    texts = []
    for n, more in [(18, 18), (18, 20), (35, 38), (66, 70)] * 3:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n + more)]
        texts += [" ".join(words[:n]), " ".join(words)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(list(enumerate(texts))), k=3, num=40).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 40, 100)))


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_texts_with_words_of_their_own_make_no_pairs(docs_of, monkeypatch, most):
    """Shingles that a few documents share, or many, pair no texts that have enough of their own."""
    from fluorite.llm import jaccard

    rng = random.Random(7)
    shared = [" ".join(rng.choices([f"s{i}" for i in range(50)], k=12)) for _ in range(60)]
    texts = []
    for i in range(120):
        parts = [shared[0], *rng.sample(shared, 6), " ".join(f"t{i}w{j}" for j in range(60))]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [t + " end" for t in texts[:20]]
    met, cut = [], jaccard.materialize

    def counted(df):
        df = cut(df)
        if df.columns == ["a", "b", "na", "nb"]:
            met.append(df.count())
        return df

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs_of(list(enumerate(texts))), most_often=most).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 90, 100))) and max(met) <= 300


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5000)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(100)) and 5000 not in got


def test_graph_search_recall():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((300, 32))
    x = unit(np.concatenate([centres + 0.05 * rng.standard_normal((300, 32)) for _ in range(8)]))
    world = SmallWorld(x)
    sims = x @ x.T
    truth = set(zip(*(v.tolist() for v in np.nonzero(sims >= 0.95)), strict=True))
    found = set(zip(*(v.tolist() for v in world.within(x, 0.95, 16)), strict=True))
    assert len(found & truth) >= 0.98 * len(truth) and not [p for p in found - truth if sims[p] < 0.95 - 1e-5]


def test_a_hub_widens_no_other_rows(monkeypatch):
    """Neighbours that are weighed while a graph with hubs is built: 1 835 403 when a hub's width held for all that were treated with it."""
    rng, seen = np.random.default_rng(6), []
    x = rng.standard_normal((6000, 48)) + 0.8
    x[:8] = 1 + 0.05 * (x[:8] - 0.8)
    choose = SmallWorld._choose
    monkeypatch.setattr(SmallWorld, "_choose", lambda self, near, sims, n: seen.append(near.size) or choose(self, near, sims, n))
    SmallWorld(unit(x).astype(np.float32))
    assert sum(seen) < 1_640_000, sum(seen)


def test_linked_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((60, 16)), 5, axis=0) + 0.05 * rng.standard_normal((300, 16))
    x[10] = x[11]
    got = {r["vec_id"]: r for r in link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95) & ~np.eye(300, dtype=bool)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * links.sum()
    assert all(r["n_links"] <= links[i].sum() for i, r in got.items())
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_a_large_group_does_not_hide_lost_small_groups(monkeypatch):
    rng = np.random.default_rng(2)
    centre, pairs = rng.standard_normal((1, 32)), rng.standard_normal((100, 32))
    x = np.concatenate([centre + 0.02 * rng.standard_normal((400, 32)), pairs, pairs + 0.02 * rng.standard_normal((100, 32))])
    blob, ids, least = build_shard(np.arange(600), x), np.arange(600), 0.95
    in_group = unit(x) @ unit(centre)[0] > 0.9
    whole = SmallWorld.within

    def short(self, q, slack, beam):
        """Small groups' links to others are lost by narrow beams."""
        i, j = whole(self, q, slack, 64)
        stays = (q[i] @ unit(centre)[0] > 0.9) | (np.einsum("nd,nd->n", q[i], self.x[j]) > 1 - 1e-6) | (beam > 16)
        return i[stays], j[stays]

    monkeypatch.setattr(SmallWorld, "within", short)
    a, b, _, beam = search_shard(blob, ids, x, least)
    assert in_group.sum() == 400 and beam > 16
    assert {(i, i + 100) for i in range(400, 500)} <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_a_search_holds_a_bounded_number_of_pairs(monkeypatch):
    """Three million pairs of one group come in parts; all at once, with the audit, they took over 100 MB."""
    import tracemalloc

    from fluorite.llm import neighbours

    rng = np.random.default_rng(5)
    x = rng.standard_normal((1, 8)) + 0.01 * rng.standard_normal((1800, 8))
    blob, ids = build_shard(np.arange(1800), x), np.arange(1800)
    monkeypatch.setattr(neighbours, "HELD", 1 << 16, raising=False)
    parts = getattr(neighbours, "search_parts", lambda z, *rest: [search_shard(blob, *rest)])
    shard = dict(np.load(io.BytesIO(blob)))
    tracemalloc.start()
    n = sum(len(a) for a, *_ in parts(shard, ids, x, 0.95))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= 0.98 * 1800**2 and peak < 50 << 20, (n, peak)


def test_a_forest_holds_the_same_nodes():
    from fluorite.llm.neighbours import forest

    rng = random.Random(9)
    pairs = np.array([(rng.randrange(40), rng.randrange(40) + 40 * (k % 3)) for k in range(300)])
    a, b = forest(pairs[:, 0], pairs[:, 1])

    def groups(edges):
        up = {}
        top = lambda i: i if up.setdefault(i, i) == i else top(up[i])
        for x, y in edges:
            up[max(top(x), top(y))] = min(top(x), top(y))
        return {i: top(i) for i in list(up)}

    assert groups(zip(a.tolist(), b.tolist(), strict=True)) == groups(map(tuple, pairs.tolist())) and len(a) < len(np.unique(pairs))


def test_many_small_shards_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 16)), 200, axis=0) + 0.01 * rng.standard_normal((200, 16)), rng.standard_normal((200, 16))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(1) - 1
    for size in (64 << 20, 128 * 40):
        got = {r["vec_id"]: r for r in link_vectors(vectors, shard_bytes=size, part_size=100).collect()}
        assert [got[i]["n_links"] for i in range(400)] == links.tolist() and all(got[i]["component_id"] == 0 for i in range(200)) and got[0]["audited_recall"] >= 0.98


# --- licences, decontamination, lines


def test_licenses(spark, docs_of):
    text = KNOWN["MIT"].replace("sublicense", "sublicence").upper()
    rows = [(1, "MIT License\n"), (2, f"Copyright (c) 2020 A. Name\n\n{text}"), (3, KNOWN["ISC"] + " more"), (4, "words\nReleased under the MIT licence!\nwords")]
    got = {r["doc_id"]: r for r in scan_licenses(docs_of(rows), known_licenses(spark)).collect()}
    assert got[2]["license"] == "MIT" and got[1]["license"] is None and got[3]["license"] is None
    assert got[4]["notices"] == ["MIT"] and got[4]["n_notice_lines"] == 1 and got[4]["license"] is None


@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_published_licences_by_digest(spark, docs_of, file, name):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no licence texts on this machine")
    text = path.read_text()
    rows = [(1, text), (2, "(c) 2020 A. Name\n" + " ".join(text.upper().split(" "))), (3, text.replace("\n", "\r\n ")), (4, text + " more")]
    got = {r["doc_id"]: r["license"] for r in scan_licenses(docs_of(rows), known_licenses(spark)).collect()}
    assert got == {1: name, 2: name, 3: name, 4: None}


def test_licences_in_both_engines(spark, docs_of, tmp_path):
    """The query's SQL and the operator on texts that the driver's tables don't hold."""
    forms = ["(c) 2020 Foo Inc\nAll rights reserved.", "© 2021 Bar\n\nall RIGHTS reserved", "Copyright Foo\n" + KNOWN["BSD-3-Clause"], KNOWN["Unlicense"].replace("\n", "\n\n  "), "sublicence \n\n organised", "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY NC 4 0", "", "\n\n", None, "noncommercial programme\nReleased under the MIT licence"]
    (tmp_path / "t").mkdir()
    docs_of(list(enumerate(forms))).coalesce(1).write.parquet(str(tmp_path / "t/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/t/documents.parquet/*.parquet'")
    result = con.execute(queries.SQL["op7_license_scan"])
    names = [d[0] for d in result.description]
    df = queries.QUERIES["op7_license_scan"](spark, str(tmp_path / "t")).select(*names)
    assert sorted(map(tuple, df.collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_forms_of_copyright_lines(spark, docs_of, end):
    forms = ["Copyright 2020 A. Name", "(c) 2020 A. Name", "© 2020 A. Name", " * (C) A. Name", "-- © A. Name"]
    rows = [(i, f"{form}{end}{end}{KNOWN['ISC']}") for i, form in enumerate(forms)]
    got = {r["doc_id"]: r["license"] for r in scan_licenses(docs_of(rows), known_licenses(spark)).collect()}
    assert got == dict.fromkeys(range(len(forms)), "ISC")


@pytest.mark.parametrize("bound", [200_000, 0])
def test_every_window_is_found(spark, docs_of, bound):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    items = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 10, 25, 40]))] for _ in range(20)]
    docs = []
    for i in range(60):
        d = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        item = rng.choice(items)
        at = rng.randrange(len(item))
        d[len(d) // 2 : len(d) // 2] = item[at : at + rng.randint(1, 20)]
        docs.append((i, " ".join(d)))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate(docs_of(docs), benchmark, broadcast_bound=bound).collect()}
    for i, text in docs:
        w, hit, found = text.split(), set(), set()
        for j, item in enumerate(items):
            n = min(10, len(item))
            runs = {tuple(item[s : s + n]) for s in range(len(item) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in runs:
                    hit.update(range(s, s + n))
                    found.add(str(j))
        assert got[i] == (len(w), len(hit), sorted(found)), i


def test_lines_that_recur_in_other_company(docs_of):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own start {chr(97 + i)}x of it\n{passage.replace('p5 ', f'p{i} ')}\nown end {chr(97 + i)}y of it") for i in range(6)]
    rows += [(100 + i, "first line here\nsecond line here\nthird line here") for i in range(50)]
    rows += [(200, passage)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in dedup_lines(docs_of(rows)).collect()}
    assert all(got[i] == (f"own start {chr(97 + i)}x of it\nown end {chr(97 + i)}y of it", 1) for i in range(6))
    assert all(got[100 + i][1] == 0 for i in range(50)) and got[200] == (passage, 0)


def test_templates_generalise_fields_without_digits(docs_of):
    rng = random.Random(21)
    name = lambda: "".join(rng.choice("bcdfghkl") for _ in range(7))
    own = [own_lines(rng, 3) for _ in range(12)]
    said = [f"session of user {name()} was closed by the server after a long wait" for _ in own]
    rows = [(i, "\n".join([x[0], s, *x[1:]])) for i, (x, s) in enumerate(zip(own, said, strict=True))]
    other = ["session of user " + " ".join(own_lines(rng, 1, 10)) for _ in range(12)]
    rows += [(100 + i, "\n".join([*own_lines(rng, 3), s])) for i, s in enumerate(other)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in dedup_lines(docs_of(rows)).collect()}
    assert all(got[i] == ("\n".join(x), 1) for i, x in enumerate(own))  # the name is a field, though it has no digit
    assert all(got[100 + i][1] == 0 for i in range(12))  # the same node, no template


def test_lines_with_three_equal_parts_share_a_template(docs_of):
    """Whatever the commonest line of a part is, and however long the chain of lines is; against brute force."""
    rng = random.Random(23)
    start = "session of user "
    near = [(0, 0, 0, k) for k in range(3)] + [(0, 0, 9, 9)] * 2  # the last is commoner and like none of them
    chain = [(20, 20, 20, 20), (21, 20, 20, 20), (21, 21, 20, 20), (21, 21, 21, 20), (21, 21, 21, 21), (22, 21, 21, 21), (22, 22, 21, 21)]
    said = near + chain + [tuple(rng.randrange(10, 16) for _ in range(4)) for _ in range(70)]
    group = list(range(len(said)))
    for i, x in enumerate(said):
        for j, y in enumerate(said[:i]):
            if sum(p == q for p, q in zip(x, y, strict=True)) >= 3:
                group = [group[j] if g == group[i] else g for g in group]
    assert {min(group.count(g), 3) for g in group} == {1, 2, 3}
    word = lambda k: "abcdefghijklmnopqrstuvwxyz"[k] * 2
    own = [own_lines(rng, 3) for _ in said]
    rows = [(i, "\n".join([*x, start + " ".join(f"{word(k)} {word(k)}" for k in parts)])) for i, (x, parts) in enumerate(zip(own, said, strict=True))]
    got = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(docs_of(rows)).collect()}
    assert got == {i: int(group.count(g) >= 3) for i, g in enumerate(group)}


def test_a_text_of_very_many_lines(docs_of):
    rng = random.Random(22)
    own = own_lines(rng, 20_000, 2)
    rows = [(1, "\n".join(x for i, line in enumerate(own) for x in ([line, "said in many texts"] if i % 4 == 0 else [line])))]
    rows += [(2 + i, "\n".join([*own_lines(rng, 5), "said in many texts"])) for i in range(4)]
    got = {r["doc_id"]: r for r in dedup_lines(docs_of(rows)).collect()}
    assert got[1]["text"] == "\n".join(own) and got[1]["n_dropped"] == 5_000 and got[1]["n_lines"] == 25_000


def own_lines(rng, n, words=12):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(words)) for _ in range(n)]


def stage_texts(spark, docs):
    import corpus_pipeline

    return {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}


def test_a_passage_at_either_end_recurs(spark, docs_of):
    rng = random.Random(11)
    passage, own = "the same passage at the ends of many texts", [own_lines(rng, 4) for _ in range(12)]
    rows = [(i, "\n".join([passage, *x] if i % 2 else [*x, passage])) for i, x in enumerate(own)]
    assert stage_texts(spark, docs_of(rows)) == {i: "\n".join(x) for i, x in enumerate(own)}


def test_a_block_of_lines_recurs(spark, docs_of):
    rng = random.Random(12)
    block, own = own_lines(rng, 4, 8), [own_lines(rng, 6) for _ in range(12)]
    rows = [(i, "\n".join([*x[: i % 7], *block, *x[i % 7 :]])) for i, x in enumerate(own)]
    assert stage_texts(spark, docs_of(rows)) == {i: "\n".join(x) for i, x in enumerate(own)}


def test_near_copies_do_not_hide_a_passage(spark, docs_of):
    rng = random.Random(13)
    passage, own = "a passage of unrelated texts and of many near copies", [own_lines(rng, 4) for _ in range(11)]
    last = [[*own[10][:3], own[10][3] + f" {''.join(rng.choice('xyz') for _ in range(9))}"] for _ in range(60)]
    rows = [(i, "\n".join([*x[:2], passage, *x[2:]])) for i, x in enumerate(own[:10] + last)]
    assert stage_texts(spark, docs_of(rows)) == {i: "\n".join(x) for i, x in enumerate(own[:10] + last)}


# --- SQL


@tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    order = sorted(names)
    plain = lambda rows, cols: sorted(tuple(f"{r[cols.index(c)]:.9g}" if isinstance(r[cols.index(c)], float) else str(r[cols.index(c)]) for c in order) for r in rows)
    df = queries.QUERIES[name](spark, SF)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), names)


@tables
def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and len(ids) > docs.count() // 2

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline as C
from pagetext.llm import near_dups as N


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, distance):
    parent = {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(set)
    for k in fps:
        groups[find(k)].add(k)
    return {frozenset(g) for g in groups.values()}


def test_classes_equal_brute_force(docs, doc_rows):
    got = N.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in doc_rows)
    want = {(r[0], f"{brute_fingerprint(r[1]):016x}") for r in doc_rows if len(r[1] or "") < 5000}
    assert want <= {(r.doc_id, r.fingerprint) for r in got}
    groups = brute_components({int(r.fingerprint, 16) for r in got}, 2)
    of = {fp: min((r.doc_id for r in got if int(r.fingerprint, 16) in g and r.doc_id is not None), default=None) for g in groups for fp in g}
    assert all(r.component_id == of[int(r.fingerprint, 16)] for r in got)


def test_xxh64_is_sparks_own(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxh64_intdigest(b"a b c", 42)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(str(i * 7919 % 104729) for i in range(5000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(N, "BLOCK", 97)
    assert N._fingerprint(text, 3) % (1 << 64) == want
    assert N._fingerprint("one two", 3) % (1 << 64) == brute_fingerprint("one two")


def test_links_lose_no_component(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
                fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    for distance in (1, 2, 3):
        pairs = N.links(df, distance)
        assert pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > distance).isEmpty()
        comp = {r.node % (1 << 64): r.component for r in N.components(pairs).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[comp.get(f, ("alone", f))].add(f)
        assert {frozenset(g) for g in groups.values()} == brute_components(fps, distance)


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u bigint, v bigint")
    comp = {r.node: r.component for r in N.components(df).collect()}
    assert comp == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_one_per_group(docs, doc_rows):
    got = N.one_per_group(docs)
    assert got.columns == docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert not [i for i in range(200, 230) if i in ids] and 7 in ids and ids[3] == 1
    assert ids[300] == 1 and 301 not in ids  # a near copy of 30,000 words
    assert ids[None] == 2  # rows without an id can't be told apart


def test_empty(no_docs):
    assert N.near_duplicates(no_docs).count() == 0 and N.one_per_group(no_docs).count() == 0


def test_similar_groups_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([60, 200, 400]))]
        rows.append(base)
        for changes in range(1, 7):  # similarity from 0.98 down to about 0.3
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes if len(base) < 100 else 2 * changes):
                copy[at] = rng.choice(words)
            rows.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(rng.sample(rows, len(rows)))] + [(900, "short text"), (901, "Short  TEXT"), (902, ""), (903, None), (904, "\n")]
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in rows for w in [(t or "").lower().split()]}
    pairs = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in N.one_per_similar_group(df).collect()}
    assert len(pairs) > 100 and kept == {i for i in sets if find(i) == i}
    assert kept < {r.doc_id for r in N.one_per_group(df).collect()}  # three words and two bits leave near copies


def test_pipeline_stage_takes_five_words_at_four_fifths(spark):
    rng = random.Random(6)
    base = [str(rng.random()) for _ in range(200)]
    near, far = [*base[:100], "x", *base[101:]], [*base[:20], *"abcdefgh", *base[28:60], "x", *base[61:100], "y", *base[101:140], "z", *base[141:170], "v", *base[171:]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((base, near, far))], "doc_id bigint, text string")
    assert {r.doc_id for r in C.drop_near_duplicates(spark, df, "").collect()} == {0, 2}


def test_every_chain_in_a_bucket_is_found(spark):
    """Groups and single texts share all buckets: components are those of all pairs, whatever the order around the bucket."""
    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(50)] for _ in range(40)]
    for _ in range(60):  # chains: each is a copy of a random earlier text with one more word at its end
        texts.append([*texts[rng.randrange(len(texts))], str(rng.random())])
    rng.shuffle(texts)
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min([least[i], *(least[j] for j in range(len(texts)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]) for i in range(len(texts))]
    one = spark.createDataFrame([(k, i, 0, 0) for i in range(len(texts)) for k in range(2)], "bucket bigint, node bigint, a bigint, b bigint")
    words = N._shingle_sets(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node bigint, t string"), 5)
    got = {r.node: r.component for r in N.similar_components(one, words).collect()}
    assert got == dict(enumerate(least)) and len(set(least)) == 40


def test_a_large_group_costs_a_few_comparisons_each(spark, monkeypatch):
    """1,500 near copies of one text in shared buckets: pairs compared stay a small multiple of the nodes, not their square."""
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(120)]
    rows = []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(120)] = f"n{i}"  # two such copies are at 0.83 or more
        rows.append((i, " ".join(copy)))
    compared = []
    plain = N._similar
    monkeypatch.setattr(N, "_similar", lambda pairs, *more: (compared.append(pairs.count()), plain(pairs, *more))[1])
    kept = N.one_per_similar_group(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert sum(compared) < 60 * 1500


def test_rows_without_an_id_are_deduplicated(spark):
    texts = ["a b c d e f g", "A b  c d e f g", "other words altogether", "only once"]
    rows = [(None, texts[0], 1), (None, texts[0], 2), (5, texts[1], 3), (None, texts[2], 4), (None, texts[2], 5), (None, texts[3], 6), (8, texts[3] + " more", 7), (8, texts[2] + " x", 8)]
    kept = N.one_per_similar_group(spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(3))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "n"] and sorted(got, key=str) == sorted([(5, texts[1]), (None, texts[2]), (None, texts[3]), (8, texts[3] + " more"), (8, texts[2] + " x")], key=str)


def test_candidates_are_all_pairs_within_two_bits(spark):
    """Buckets of the ball hashing join exactly the nodes with one of the seeded fingerprints at two or fewer differing bits."""
    rng = random.Random(12)
    rows = []
    for _ in range(12):
        base = [rng.getrandbits(64) for _ in N.SKETCHES]
        for _ in range(12):  # further and further from the first, each of its words by a few bits
            rows.append([x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for x in base])
    signed = [(n, *(x - (1 << 64) if x >> 63 else x for x in r)) for n, r in enumerate([*rows, rows[0]])]
    nodes = spark.createDataFrame(signed, "node bigint, " + ", ".join(f"{c} bigint" for c in N.SKETCHES))
    prints = [[x >> at & 0xFFFFFFFF for x in r for at in (0, 32)] for r in [*rows, rows[0]]]
    want = {(i, j) for i in range(len(prints)) for j in range(i) if any((x ^ y).bit_count() <= 2 for x, y in zip(prints[i], prints[j]))}
    buckets = defaultdict(set)
    for r in N._candidates(nodes).collect():
        buckets[r.bucket].add(r.node)
    assert {(i, j) for b in buckets.values() for i in b for j in b if i > j} == want and len(want) > 300


def test_close_pairs_of_a_bucket_in_pieces(spark, monkeypatch):
    """A bucket of several pieces gives the close pairs of different components of all its members, each node outside of the largest one asking."""
    rng = random.Random(13)
    base = [rng.getrandbits(62) for _ in range(6)]
    rows = [(7, n, *(x ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(14))) for x in base), n % 5, 0, 120) for n in range(120)]
    state = spark.createDataFrame(rows, "bucket bigint, node bigint, a bigint, b bigint, c bigint, d bigint, e bigint, f bigint, component bigint, top bigint, n bigint")
    far = {(u[1], v[1]): sum((x ^ y).bit_count() for x, y in zip(u[2:8], v[2:8])) for u in rows for v in rows if u[1] < v[1] and u[8] != v[8]}
    monkeypatch.setattr(N, "PIECE", 31)
    got = sorted(map(tuple, N._met(state, list(N.SKETCHES), None).collect()))
    assert got == sorted(k for k, d in far.items() if d <= N.FAR) and 100 < len(got) < len(far)
    few = {tuple(r) for r in N._met(state, list(N.SKETCHES), 1).collect()}
    assert few < set(got) and len(few) <= 96

"""Every operator against a plain restatement of its contract, on small awkward tables."""

import collections
import hashlib
import math
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosspan.llm import common, components, decontamination, exact_dedup, jaccard, language, licences, lm, mixing, pii, recurring, scan, secrets, substrings

DATA = "/root/testdata/sf0.01"
BLANK = r"[\x20\x09-\x0D]"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def widened(docs, names):
    for name in names:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup(spark, make, awkward, clashing):
    docs = widened(make(awkward), clashing)
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decide(docs, exact_dedup.DigestIndex(spark)).collect())
    groups = collections.defaultdict(list)
    for i, t, *_ in awkward:
        groups[re.sub(BLANK, "", t or "")].append((-len(t or ""), i is None, i))
    expected = sorted((i or -1, min(groups[k])[2], len(groups[k]), i == min(groups[k])[2], sha(k)) for i, t, *_ in awkward for k in [re.sub(BLANK, "", t or "")])
    assert got == expected
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == len(groups)


def test_exact_dedup_in_batches(spark, make, awkward, clashing):
    """However documents are dealt to batches, the result is that of one batch."""
    docs = widened(make(awkward), clashing)
    pick = lambda frame: sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept, r.text_sha256) for r in frame.collect())
    whole = pick(exact_dedup.decide(docs, exact_dedup.DigestIndex(spark)))
    for batches in (2, 5):
        index = exact_dedup.DigestIndex(spark, buckets=3)
        assert pick(exact_dedup.decide(docs, index, batches)) == whole
        index.compact()
        assert index.rows().count() == len({r[-1] for r in whole})
        index.drop()


def test_a_compaction_that_broke_off_is_ended(spark, make):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    exact_dedup.decide(make([(1, "a"), (2, "b")]), index).collect()
    spark.sql(f"ALTER TABLE {index.name} RENAME TO {index.name}_compacted")
    found = exact_dedup.decide(make([(3, "a"), (4, "c")]), index)
    assert {(r.doc_id, r.keep_id) for r in found.collect()} == {(3, 1), (4, 4)}
    index.drop()


def test_maps_grow_with_their_keys(spark, monkeypatch):
    assert [scan.map_bits(n) for n in (0, 1 << 17, (1 << 17) + 1, 1 << 25, (1 << 25) + 1)] == [20, 20, 21, 28, None]
    rows, keys = spark.range(500), spark.range(0, 500, 7)
    for most in (28, 5):
        monkeypatch.setattr(scan, "MOST", most)
        kept = {r.id for r in scan.kept_by_map(rows, keys, "id").collect()}
        assert kept >= set(range(0, 500, 7)) and len(kept) < 100


def test_digest_index_is_incremental(spark, make):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = exact_dedup.decide(make([(1, "a b"), (2, "c")]), index)
    assert {(r.doc_id, r.keep_id) for r in first.collect()} == {(1, 1), (2, 2)}
    second = exact_dedup.decide(make([(3, "ab"), (4, "d"), (5, "d")]), index)
    assert {(r.doc_id, r.keep_id, r.kept) for r in second.collect()} == {(3, 1, False), (4, 4, True), (5, 4, False)}
    plan = index.unseen(index.rows().select("digest").limit(1))._jdf.queryExecution().executedPlan().toString()
    assert index.rows().count() == 3 and "SortMergeJoin" in plan
    index.drop()


def brute_pii(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, rule in rules.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            holds = {"ip": lambda s=m[0]: all(int(x) <= 255 for x in s.split(".")), "card": lambda d=digits: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0, "phone": lambda d=digits: 8 <= len(d) <= 15}.get(kind, lambda: True)
            if holds():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(make, awkward):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i, alphabet in enumerate(["0123456789.- +()", "ab@.-+ 1", "1.2 5+", "0 -"] * 150)]
    rows += [(1000, "😀 pay 4111 1111-1111 1111, Account no. 12345-6789 see https://a.org/x?y. IBAN GB82 WEST 1234 5698 7654 32 at 12 High Street"), *[(r[0], r[1]) for r in awkward]]
    got = pii.find(make(rows)).collect()
    assert len(got) == len(rows)
    texts = collections.Counter((i, sha(brute_pii(t))) for i, t in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == texts
    anchors = pii.automaton()
    kinds = lambda t: [(k, t[a:b]) for k, found in pii.spans(t, anchors).items() for a, b in found]
    assert kinds("account" + " " * 72 + "1234567890123") == [("account", "1234567890123")]
    assert kinds("İ aCCount: 99887766") == [("account", "99887766")]
    assert kinds("account 1234567890123456789012345678901234567890") == []
    extra = next(r.spans for r in got if r.doc_id == 1000)
    assert {s.split(":")[0] for s in extra.split(",")} == {"card", "account", "url", "iban", "address"}


def brute_secrets(text):
    found = []
    for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 8)
    for m in re.finditer(r"AKIA[A-Z0-9]+", text or ""):
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}")] * (len(m[0]) >= 16)
    for m in re.finditer(r"[0-9a-f]+", text or ""):
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}")] * (len(m[0]) >= 32)
    return ",".join(x[2] for x in sorted(found))


def test_secrets_and_ledger(spark, make, awkward):
    rng = random.Random(2)
    pieces = ["password", "Token", "api_key", "secret", ":", "=", " ", '"', "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "x", "\n", "==", "é"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))) for i in range(300)] + [(r[0], r[1]) for r in awkward]
    ledger = secrets.BlobLedger(spark)
    got = secrets.scan(make(rows), ledger).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == collections.Counter((i, sha(brute_secrets(t))) for i, t in rows)
    blobs = len({t or "" for _, t in rows})
    assert spark.table(ledger.name).count() == blobs and secrets.scan(make([]), ledger).count() == 0
    again = make([*rows[:5], (999, "token: abcdefgh12")])
    assert secrets.scan(again, ledger).count() == 6 and spark.table(ledger.name).count() == blobs + 1
    assert secrets.scan(again, ledger, 2).count() == 6 and spark.table(ledger.name).count() == blobs + 1 + 6
    extra = secrets.spans("-----BEGIN RSA PRIVATE KEY----- ghp_" + "aZ" * 18)
    assert {kind for _, kind, _ in extra} == {"private_key", "service_token"}


def brute_hits(docs, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    out = []
    for i, t, *_ in docs:
        mine, hit, met = split(t), set(), set()
        for item, body in items:
            w = split(body)
            n = min(size, len(w))
            for a in range(len(w) - n + 1) if w else ():
                for p in range(len(mine) - n + 1):
                    if mine[p : p + n] == w[a : a + n]:
                        hit |= set(range(p, p + n))
                        met.add(str(item) if item is not None else "")
        out.append((i, len(mine), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return collections.Counter(out)


def test_decontamination(spark, make, awkward, clashing):
    rng = random.Random(3)
    vocabulary = ["Aa", "b", "c1", "dé", "e"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 7, 10, 14])))) for i in range(10)]
    items += [(100, None), (101, "..."), (None, "b b c1"), (3, "e e e e e e e e e e e e")]
    rows = [(200 + i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(300 + i, "x y " + items[i][1].lower() + " z") for i in range(10)] + [(r[0], r[1]) for r in awkward]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(make(rows), table).collect())
    expected = brute_hits(rows, items)
    assert got == expected
    docs = widened(make(rows), clashing)
    left = decontamination.clean(docs, table)
    assert left.columns == docs.columns and left.count() == sum(n for k, n in expected.items() if not k[-1])
    assert decontamination.decontaminate(make(rows[:3]), table.limit(0)).where("contaminated").count() == 0


def test_mixing(make, awkward, clashing):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), "en", rng.choice(["a", "a", "a", "B", "é", None, "c"])) for i in range(200)] + list(awkward)
    for block in (1, 256):
        docs = widened(make(rows), clashing)
        got = mixing.mix(docs, block).collect()
        assert len(got) == len(rows)
        sizes, taken, target = collections.Counter(), collections.Counter(), {}
        for r in got:
            assert 0 <= r.taken <= 2 * r["size"]
            assert (r.first_slot is None) == (r.n_slots == 0) == (r.taken == 0)
            sizes[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
        assert all(r.source_size == sizes[r.source] for r in got)
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)
        assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
        order = sorted(target, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        levels = {round(target[s] / weight[s], 3) for s in target if target[s] < 2 * sizes[s] - 1e-3}
        assert len(levels) <= 1
    half = 1 + max(r.first_slot or 0 for r in got) // 2
    first = mixing.mix(docs, block, upto=half).collect()
    assert all(r.first_slot is None or r.first_slot < half for r in first) and 0 < sum(r.taken for r in first) < sum(taken.values())
    assert mixing.mix(make([])).count() == 0


def brute_schedule(needs, upto):
    """(source, slot, k) by walking over the van der Corput points."""
    m = max(1, (max(sum(needs.values()), 1) - 1).bit_length())
    cells = [name for name in sorted(needs) for _ in range(needs[name])]
    out, ranks = [], collections.Counter()
    for slot in range(min(1 << m, upto)):
        point = int(format(slot, f"0{m}b")[::-1], 2)
        if point < len(cells):
            out.append((cells[point], slot, ranks[cells[point]]))
            ranks[cells[point]] += 1
    return out


@pytest.mark.parametrize("needs", [{"a": 1}, {"a": 7, "b": 300, "c": 1, "d": 33}, {"a": 512, "b": 512}, {f"s{i:03}": 1 + i % 9 for i in range(150)}])
def test_mixing_schedule(spark, needs):
    goals = spark.createDataFrame([(False, name, 64 * n - 3) for name, n in needs.items()], "none boolean, name string, take long")
    for upto in (1 << 20, 100):
        got = sorted((r.name, r.slot, r.k) for r in mixing.schedule(goals, 64, upto).collect())
        assert got == sorted(brute_schedule(needs, upto))
    total = sum(needs.values())
    met = collections.Counter(name for name, _, _ in brute_schedule(needs, 1 << 20))
    assert met == needs
    walk = brute_schedule(needs, 1 << 20)
    for n in range(1, total, 37):
        part = collections.Counter(name for name, _, _ in walk[:n])
        assert all(abs(part[name] - n * needs[name] / total) <= 2 + math.log2(total) / 2 for name in needs)


def test_mixing_is_what_the_schedule_decides(make, monkeypatch):
    """Another schedule gives another mix."""
    docs = make([(i, "w " * 50, "en", "ab"[i % 2]) for i in range(60)])
    real = mixing.schedule
    whole = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(docs, 16).collect()}
    monkeypatch.setattr(mixing, "schedule", lambda *a: real(*a).where("k % 2 = 0"))
    other = {r.doc_id: (r.taken, r.first_slot) for r in mixing.mix(docs, 16).collect()}
    assert sum(t for t, _ in other.values()) < 0.6 * sum(t for t, _ in whole.values())


def shingles(text, k):
    w = words((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a][1] & sets[b][1])
            if common and 100 * common >= percent * len(sets[a][1] | sets[b][1]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min((s[0] for s, y in zip(sets, label, strict=True) if y == x and s[0] is not None), default=None) for x in label}
    return collections.Counter((s[0], len(s[1]), least[x] if s[1] else s[0]) for s, x in zip(sets, label, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard(make, awkward, k, percent):
    rng = random.Random(k)
    rows = [(r[0], r[1]) for r in awkward]
    for g in range(12):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.choice([4, 9, 20, 60, 150]))]
        for _ in range(rng.randint(2, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = "new" + str(rng.randint(0, 99))
            rows.append((1000 + len(rows), " ".join(text)))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(make(rows), k, percent).collect())
    assert got == brute_components(rows, k, percent)


def test_jaccard_tasks_have_one_python_worker_each(make, awkward, monkeypatch):
    """Rows that go from one Python function to the next in a task need as many workers, each with memory of its own."""
    met = {}
    for module in (jaccard, recurring):

        def counted(df, label, kept=module.staged):
            met[label] = max(met.get(label, 0), df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow"))
            return kept(df, label)

        monkeypatch.setattr(module, "staged", counted)
    assert jaccard.join(make(awkward)).count() == len(awkward)
    assert met["marked"] == met["values"] == 1 and max(met.values()) == 1


@pytest.mark.parametrize("block", [jaccard.BLOCK, 3])
def test_jaccard_compares_all_that_may_link_in_a_cluster(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([pool[:s], rng.integers(1, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for s in rng.integers(30, 200, 60).tolist()]
    rows = [(i, i % 7, 1, len(s), [int(v) for v in jaccard.parities(s).view(np.int64)]) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "node long, label long, cluster long, n long, value array<long>")
    got = {tuple(sorted((r.u, r.v))) for r in jaccard.across(members, 80).collect()}
    linked = {(a, b) for b in range(60) for a in range(b) if a % 7 != b % 7 and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= got and len(linked) > 20


def test_jaccard_keeps_one_of_each_group(make, awkward, clashing):
    docs = widened(make(awkward), clashing)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    expected = {i for (i, _, c) in brute_components(awkward, 5, 80) if i == c}
    assert ids - {None} == expected - {None}
    assert jaccard.join(make([])).count() == 0


@pytest.mark.parametrize("percent", range(50, 100))
def test_jaccard_prefixes_of_all_sizes(percent):
    """Partners of any sizes share as many prefix tokens as either one asks for, however their other tokens lie."""
    plan = jaccard.Plan(percent, 1)
    for n in range(1, 260):
        for m in range(n, n * 100 // percent + 1):
            common = -(-percent * (n + m) // (100 + percent))  # the fewest that reach the threshold
            if common <= n:
                shared = min(common, plan.prefix(n) - (n - common), plan.prefix(m) - (m - common))
                assert shared >= max(plan.needed(n), plan.needed(m)), (n, m)
                assert plan.band(m) - plan.band(n) in (0, 1)


def test_jaccard_at_high_thresholds(make):
    row = lambda n: " ".join(f"w{i}" for i in range(n))
    for percent, n in ((95, 20), (99, 100)):
        got = jaccard.join(make([(1, row(n)), (2, row(n - 1))]), 1, percent).collect()
        assert {r.component_id for r in got} == {1}


def test_recurring_rows(spark, monkeypatch):
    rng = random.Random(61)
    rows = [(rng.randint(0, 40) if rng.random() < 0.5 else 7, rng.randint(0, 9), rng.randint(0, 2)) for _ in range(600)] + [(100, 1, 1)] * 5
    things = collections.defaultdict(set)
    for key, *of in rows:
        things[key].add(tuple(of))
    expected = {(k, *t) for k, ts in things.items() if len(ts) > 1 for t in ts}
    frame = spark.createDataFrame(rows, "k long, a long, b int").repartition(3)
    assert {tuple(r) for r in recurring.recurring(frame, "k", ["a", "b"]).collect()} == expected


@pytest.mark.parametrize("hot", [components.HOT, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 150), rng.randint(100, 150)) for _ in range(40)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: y for x, y in label.items() if x not in loops}


def brute_repeats(rows, length):
    out, seen, done = {}, set(), {}
    for i, t in sorted({(i if i is not None else 2**63 - 1, t or "") for i, t, *_ in rows}):
        body = t.encode()
        covered = bytearray(len(body))
        here = []
        for a in range(len(body) - length + 1):
            piece = body[a : a + length]
            if piece in seen:
                covered[a : a + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(c for c, x in zip(body, covered, strict=True) if not x)
        runs = len(re.findall(b"\1+", bytes(covered)))
        out[i, t] = (len(body), sum(covered), runs, sha(kept))
    return out


@pytest.mark.parametrize(("length", "width", "alphabet"), [(100, 36, "ab"), (12, 5, "ab "), (12, 12, "abcdefgh é"), (9, 4, "a")])
def test_repeats(make, awkward, monkeypatch, length, width, alphabet):
    rng = random.Random(length)
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 160))) for _ in range(6)]
    rows = [(500 + i, "".join(rng.choice(shared) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(r[0], r[1]) for r in awkward]
    expected = brute_repeats(rows, length)
    monkeypatch.setattr(substrings, "hot_ranks", lambda found, real=substrings.hot_ranks: real(found) if length != 12 else np.sort(np.array([r.rank for r in found.select("rank").distinct().collect()][::2], np.int64)))
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(make(rows), length, width).collect())
    assert got == collections.Counter((i, *expected[i if i is not None else 2**63 - 1, t or ""]) for i, t in rows)


def test_language(spark, make, awkward, clashing):
    rng = random.Random(8)
    parts = {"en": ["the", "ing", "th", "sh", "ou"], "fr": ["é", "que", "eau", "les", "ou"], "de": ["sch", "ung", "ü", "der", "ei"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(5, 60))), lang) for i, lang in enumerate(["en", "en", "fr", "de"] * 60)]
    docs = make(rows)
    filters = language.fit(docs.where("doc_id % 5 <> 2"))
    got = {r.doc_id: r for r in language.identify(docs, filters, ["doc_id"]).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = language.identify(widened(make(awkward), clashing).select(F.struct("*").alias("all"), "text"), filters, ["all"]).collect()
    assert len(odd) == len(awkward)
    assert all((r.lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r.all.text or "")) for r in odd)
    signs = language.identify(make([(1, "½ ² 12 _"), (2, "½ a")]), filters, ["doc_id"]).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in signs} == {1: True, 2: False}
    assert language.fit(make([(1, "aaa bbb", "yy"), (2, "ccc ddd", "xx")])).default == "xx"
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_language_is_that_of_plain_counts(make):
    """Against sets of n-grams in place of the filter, for every text."""
    rng = random.Random(81)
    parts = {"en": ["the", "ing", "th", "sh", "ou"], "fr": ["é", "que", "eau", "les", "ou"], "de": ["sch", "ung", "ü", "the", "ei"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(["en", "fr", "de"] * 60)]
    fold = lambda t: bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in t.encode())
    grams = lambda t: [fold(t)[i : i + n] for n in (3, 4, 5) for i in range(len(fold(t)) - n + 1)]
    counts = {lang: collections.Counter(g for _, t, x in rows if x == lang for g in grams(t)) for lang in parts}
    counts = {lang: {g: n for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    held = {lang: {g for g, x in c.items() if x >= 0.6 * max(r.get(g, 0) for r in rate.values())} for lang, c in rate.items()}
    got = {r.doc_id: r.lang_pred for r in language.identify(make(rows), language.fit(make(rows)), ["doc_id"]).collect()}
    for i, t, _ in rows:
        found = {lang: sum(g in held[lang] for g in grams(t)) for lang in held}
        assert found[got[i]] >= max(found.values()) - 0.02 * len(grams(t))


def test_language_sample_is_bounded(make):
    docs = make([(i, f"text {i}", "en" if i % 3 else "de") for i in range(3000)] + [(5000, None, "en"), (5001, "x", None)])
    sample, sizes = language.sampled(docs, 100)
    assert sizes == {"en": 2000, "de": 1000} and {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 100, "de": 100}
    smallest = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(3000) if i % 3)[:100]
    assert {hashlib.md5(r.text.split()[1].encode()).hexdigest() for r in sample.where("lang = 'en'").collect()} == set(smallest)


def test_more_than_64_languages(make):
    rng = random.Random(80)
    parts = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(5)] for k in range(70)}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(20)), lang) for i, lang in enumerate([*parts] * 4)]
    filters = language.fit(make(rows))
    assert filters.names == sorted(parts)
    got = {r.doc_id: r.lang_pred for r in language.identify(make(rows), filters, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.97 * len(rows)


def test_lm_scoring(spark, make, awkward):
    rng = random.Random(9)
    lexicon = ["".join(rng.choice(["ti", "on", "er", "the", "éa", "sch"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(lexicon).title() for _ in range(rng.randint(1, 150)))) for i in range(150)] + [(r[0], r[1]) for r in awkward]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*words((t or "").translate(FOLD)), None]) for i, t in rows]
    counts = collections.Counter(w for i, ts in tokens if not held(i) for w in ts)
    n, v = sum(counts.values()), len(counts)
    docs = make(rows).select("doc_id", "text", (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(-1)) == 0).alias("held_out"))
    fitted = lm.Fitted(docs.where("NOT held_out"))
    got = sorted(((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.held_out), r.base_score, r.score) for r in lm.score(docs, fitted).collect())
    expected = sorted(((i or -1, len(ts), sum(counts[w] > 0 for w in ts), n, held(i)), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) for i, ts in tokens)
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert all(g[1] == pytest.approx(e[1]) for g, e in zip(got, expected, strict=True))
    assert all(g[2] < 0 for g in got)
    again = sorted(r.score for r in lm.score(docs, fitted).collect())
    assert again == sorted(g[2] for g in got)


def test_lm_scores_do_not_depend_on_partitions(spark, make):
    rng = random.Random(90)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "the", "éa"]) * rng.randint(1, 3) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    found = []
    for n in (1, 8):
        docs = make(rows).repartition(n).select("doc_id", "text", (F.col("doc_id") % 10 == 0).alias("held_out"))
        found.append({r.doc_id: round(r.score, 6) for r in lm.score(docs, lm.Fitted(docs.where("NOT held_out"))).collect()})
    assert found[0] == found[1]


def test_lm_learners_are_no_more_with_more_partitions(make, monkeypatch):
    """Each learner's tables are shuffled, so their number is that of the data's, whatever the number of partitions."""
    docs = make([(i, f"the word {i % 9} of {i}") for i in range(200)])
    kind, seen = type(docs), []

    def met(self, run, schema, *rest):
        out = kept_map(self, run, schema, *rest)
        if schema == lm.BLOCKS and "text" in self.columns:
            seen.append(out.where("predictor = 5").count())
        return out

    kept_map, keyed, by_id = kind.mapInArrow, kind.repartition, getattr(kind, "repartitionById", None)
    monkeypatch.setattr(kind, "mapInArrow", met)
    models = [lm.Fitted(docs).model]
    more = lambda n, columns: max(n, 211) if isinstance(n, int) and columns else n
    monkeypatch.setattr(kind, "repartition", lambda self, n, *columns: keyed(self, more(n, columns), *columns))
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, column: by_id(self, 211, column), raising=False)
    models.append(lm.Fitted(docs).model)
    assert seen == [lm.LEAST_TASKS, lm.LEAST_TASKS]
    assert np.array_equal(models[0].last, models[1].last) and np.allclose(models[0].weights, models[1].weights)


def test_many_sources_are_mixed_in_one_pass(spark, make, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 50)
    rng = random.Random(40)
    rows = [(i, "w " * rng.randint(0, 9), "en", f"s{rng.randint(0, 400):03}") for i in range(1500)]
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    budget, target = 1.5 * sum(sizes.values()), {}
    while len(target) < len(sizes):
        rest = [s for s in sizes if s not in target]
        level = (budget - sum(target.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in above} or {s: weight[s] * level for s in rest}
    got = {r.source: (r.target, r.source_size) for r in mixing.mix(make(rows)).collect()}
    assert set(got) == set(sizes) and all(got[s][0] == pytest.approx(target[s], abs=1e-5) and got[s][1] == sizes[s] for s in sizes)


def test_language_tables_are_bounded(spark, make, monkeypatch):
    rows = [(i, " ".join(f"{a}{b}" for a in "abcdef"[: i % 6 + 1] for b in "ghijkl") * 2, "en") for i in range(60)]
    whole = language.fit(make(rows)).tables.any(axis=0).sum()
    monkeypatch.setattr(language, "TABLE_BYTES", 8 * 8 * 60)
    few = language.fit(make(rows)).tables.any(axis=0).sum()
    assert 0 < few <= 3 * 60 < whole


def naive_costs(model, text):
    """log10 of each token's probability: the model applied decision by decision, from its tables."""
    tokens = [w.encode() + b" " for w in words(text.translate(FOLD))] + [b"\n"]
    stream, base, mask = b"".join(tokens), int(lm.BASE), 2**64 - 1
    scramble = lambda x, seed=0: int(lm.mix(np.array([x & mask], np.uint64), seed)[0])
    rolled = lambda part: sum((c + 1) * pow(base, i, 2**64) for i, c in enumerate(part)) & mask
    named = [scramble(rolled(t[:-1]) + len(t)) for t in tokens]
    own, wrong, met = np.zeros(lm.PREDICTORS), collections.Counter(), collections.Counter()
    cost, begin, size, at, number, inside = [0.0] * len(tokens), 0, lm.SEGMENT, 0, 0, 0
    while begin < len(stream):
        slope, n, missed, seen = np.zeros(lm.PREDICTORS), 0, collections.Counter(), collections.Counter()
        for at in range(begin, min(begin + size, len(stream))):
            back = int.from_bytes(stream[max(0, at - 5) : at][::-1], "little")
            pair = (back & 255) << 8 | stream[at]
            so_far = rolled(tokens[number][:inside])
            keys = [back & 0xFFFF, back & 0xFFFFFFFF]
            folded = [so_far, (so_far + (named[number - 1] if number else 0) * base) & mask]
            keys += [x ^ x >> 29 for x in folded]
            contexts = [(back & 255) << 8] + [(k * int(s) & mask) >> (64 - model.bits) for k, s in zip(keys, lm.SPREAD[1:], strict=True)]
            for step in range(model.code.depth[pair]):
                node, bit = int(model.code.nodes[model.code.offset[pair] + step]), int(model.code.bits[model.code.offset[pair] + step])
                x = np.array([float(model.odds[k][c ^ int(model.marks[k][node])]) for k, c in enumerate(contexts)])
                gate = int(np.count_nonzero(x[-3:])) * 3 + min(inside, 2)
                odds = float(np.clip(x @ (model.weights[:, gate] + own), -11.99, 11.99))
                p, cell = 1 / (1 + math.exp(-odds)), int(odds + lm.LEVELS / 2)
                final = (p + model.last[node * lm.LEVELS + cell]) / 2 + wrong[cell] / (lm.INERTIA + met[cell])
                final = min(max(final, 2e-5), 1 - 2e-5)
                cost[number] += math.log10(final if bit else 1 - final)
                slope, n = slope + (bit - p) * x, n + 1
                missed[cell] += bit - final
                seen[cell] += 1
            number, inside = (number + 1, 0) if inside + 1 == len(tokens[number]) else (number, inside + 1)
        own = own + lm.OWN_RATE / lm.UNIT**2 * slope / (n + lm.INERTIA)
        wrong.update(missed)
        met.update(seen)
        begin += size
        size = min(begin, lm.LONGEST)
    return cost


def fitted_on(spark, texts, bits=14):
    """A model learned from texts, and the learner, without Spark."""
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    stream = lm.Stream(np.frombuffer("".join(texts).encode(), np.uint8), ends)
    before = np.append(0, stream.symbols[:-1]).astype(int)
    before[stream.start] = 0
    learner = lm.Learner(lm.Code(np.bincount(before << 8 | stream.symbols, minlength=lm.SYMBOLS**2)), bits)
    for _ in range(3):
        learner.due = 0
        learner.learn(stream)
    return lm.Model(learner.code, bits, [lm.log_odds(c) for c in learner.counts], learner.rest())


def test_lm_costs_are_those_of_single_decisions(spark):
    rng = random.Random(91)
    lexicon = ["".join(rng.choice(["ti", "on", "er", "the", "éa", "sch"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rng.choice(lexicon) for _ in range(rng.randint(0, 120))) for _ in range(25)]
    model = fitted_on(spark, texts)
    asked = ["", "the  Tion \t\n zebra", " ".join(texts)[:1500], texts[3], "x" * 300, "日本 the"]
    body = "".join(asked).encode()
    got = model.costs(lm.Stream(np.frombuffer(body, np.uint8), np.cumsum([0, *(len(t.encode()) for t in asked)])))
    expected = [c for t in asked for c in naive_costs(model, t)]
    assert len(got) == len(expected) and np.allclose(got, expected, rtol=1e-4, atol=1e-4)


def test_lm_probabilities_sum_to_one(spark):
    """Over every next byte, after contexts known and unknown."""
    model = fitted_on(spark, ["a b ab ba aa a b", "ab ab a"] * 5)
    for context in ("", "a", "ab ", "zz"):
        total = 0.0
        for byte in range(256):
            s = lm.Stream(np.frombuffer(context.encode() + b"q", np.uint8), np.array([0, len(context) + 1])).prepare()
            at = len(context.encode())
            s.symbols = s.symbols.copy()
            s.symbols[at] = byte
            d = lm.Decisions(s, np.array([at]), model.code, model.marks, model.bits)
            x, gate = d.inputs(model.odds)
            odds = lm.clipped((x * model.weights[:, gate]).sum(axis=0))
            p = (lm.sigmoid(odds) + model.last[d.node * lm.LEVELS + lm.level(odds)]) / 2
            total += float(np.prod(np.where(d.bit == 1, p, 1 - p)))
        assert total == pytest.approx(1, rel=1e-4)


@pytest.mark.skipif(not os.path.exists(f"{DATA}/documents.parquet"), reason="needs the test tables")
def test_lm_beats_a_proper_unigram_on_held_out_texts(spark):
    """Against shares of words, and unknown words spelled by shares of bytes."""
    rows = [(r.doc_id, words((r.text or "").translate(FOLD))) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {r.doc_id: r for r in lm.op5_lm_scoring(spark, DATA).where("held_out").collect()}
    counts = collections.Counter(w for i, ws in rows if not held(i) for w in [*ws, None])
    letters = collections.Counter(c for w in counts.elements() for c in (w or "").encode() + b" ")
    n, m = sum(counts.values()), sum(letters.values())
    new = sum(c == 1 for c in counts.values()) / n
    price = lambda w: math.log10((1 - new) * counts[w] / n) if counts[w] else math.log10(new) + sum(math.log10((letters[c] + 1) / (m + 256)) for c in w.encode() + b" ")
    proper = sum(price(w) for i, ws in rows if held(i) for w in [*ws, None])
    total, tokens = sum(r.score for r in got.values()), sum(r.n_tokens for r in got.values())
    assert total > proper + 0.2 * tokens
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (len(" ".join(ws).encode()) + 1 + (len(ws) > 0))) for i, ws in rows if held(i) for r in [got[i]])


def test_lm_learns_from_all_training_texts(make):
    fitted = lm.Fitted(make([(i, "a b ab") for i in range(4500)]))
    assert fitted.n == 4 * 4500
    assert fitted.model.last.reshape(lm.NODES, lm.LEVELS).shape == (lm.NODES, lm.LEVELS) and any(np.abs(o).max() > 60 for o in fitted.model.odds)


def test_lm_without_training(make):
    docs = make([(1, "a b"), (2, None)]).select("doc_id", "text", F.lit(True).alias("held_out"))
    rows = lm.score(docs, lm.Fitted(docs.limit(0))).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 3, 0, 0), (2, 1, 0, 0)}


def test_licences(spark, make, awkward):
    noisy = "Copyright (c) 2020 Somebody\n" + licences.MIT.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(".", " ;")
    rows = [(900, noisy), (901, "x\nLicenced under the Apache License; version 2.0\ny\nReleased under the MIT license"), (902, licences.ISC + " more"), *[(r[0], r[1]) for r in awkward]]
    got = {r.doc_id: r for r in licences.scan(make(rows), licences.known_digests(spark)).collect()}
    assert got[900].licence == "MIT" and got[901].notices == "Apache-2.0,MIT" and got[901].n_notices == 2
    assert got[902].licence is None and got[1].licence is None and got[1].n_notices == 0


def test_whole_licence_texts(spark, make):
    names = sorted(path.stem for path in licences.FILES.glob("*.txt"))
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense"} <= set(names)
    body = lambda name: (licences.FILES / f"{name}.txt").read_text(encoding="utf-8")
    rows = [*enumerate(map(body, names)), (100, "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\nAll rights reserved.\n\n" + body("BSD-3-Clause")), (101, body("Apache-2.0").split("   APPENDIX")[0]), (102, body("GPL-3.0-only")[:9000])]
    got = {r.doc_id: r.licence for r in licences.scan(make(rows), licences.known_digests(spark)).collect()}
    assert got == {**dict(enumerate(names)), 100: "BSD-3-Clause", 101: "Apache-2.0", 102: None}


def test_repeats_keeps_a_passage_of_a_repeated_representative(make):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(4, text), (4, text), (11, text + " and more")]
    expected = brute_repeats(rows, 100)
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(make(rows)).collect())
    assert got == collections.Counter((i, *expected[i, t]) for i, t in rows)


def test_every_operator_takes_odd_tables(spark, make, awkward, clashing):
    """Clashing columns change nothing, and an empty table gives an empty result."""
    rows = awkward[:14]
    items = spark.createDataFrame([(1, "no id at all here"), (2, None)], "item_id long, text string")
    held = (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(-1)) == 0).alias("held_out")
    runs = {
        "dedup": lambda d: exact_dedup.decide(d, exact_dedup.DigestIndex(spark)),
        "pii": pii.find,
        "decontamination": lambda d: decontamination.decontaminate(d, items),
        "mixing": mixing.mix,
        "lm": lambda d: lm.score(d.select("*", held), lm.Fitted(d)),
        "secrets": lambda d: secrets.scan(d, secrets.BlobLedger(spark)),
        "licences": lambda d: licences.scan(d, licences.known_digests(spark)),
        "language": lambda d: language.identify(d, language.fit(d), ["doc_id"]),
        "jaccard": lambda d: jaccard.join(d).drop("node"),
        "repeats": substrings.remove_repeats,
    }
    plain, wide = make(rows), widened(make(rows), clashing)
    for name, run in runs.items():
        listed = lambda d: collections.Counter(map(tuple, run(d).collect()))  # noqa: B023, E731
        assert listed(plain) == listed(wide), name
        assert run(widened(make([]), clashing)).count() == 0, name


def test_very_long_texts(make):
    """Five million bytes of one sign, and of digits, go through every operator that runs in Python."""
    rows = [(1, "a" * 5_000_000), (2, "7" * 5_000_000), (3, "a b"), (4, "1.2.3.4 " * 300_000)]
    docs = make(rows)
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 4_999_999, 2: 4_999_999, 3: 0, 4: 2_400_000 - 8}
    assert {r.doc_id: r.n_ip for r in pii.find(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 300_000}
    assert {r.doc_id for r in jaccard.join(docs).collect()} == {1, 2, 3, 4}
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit(docs.where("doc_id = 3")), ["doc_id"]).collect()} == {1: "en", 2: "und", 3: "en", 4: "und"}


def test_key_map_drops_no_match(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = spark.range(5000).selectExpr("id % 700 AS k", "id AS v")
    side = spark.range(0, 7000, 7).selectExpr("id AS k", "'x' AS w")
    assert common.lookup(rows, side, ["k"], 16).count() == rows.where("k % 7 = 0").count()
    assert common.may_hold(rows, side, ["k"]).count() < 1500

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from palimpsest.llm import secrets
from test_mixing import brute_targets
from test_neardup import kept_by_brute_force
from test_quality import brute as quality_brute
from test_tokens import whole


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = cp.quality_rules(spark, docs, small)
    assert kept.columns == docs.columns
    good = {i for i, r in rows.items() if not quality_brute(r.text)[5]}
    assert {r.doc_id for r in kept.collect()} == good
    single = cp.near_dedup(spark, kept, small)
    assert single.columns == docs.columns
    ids = sorted(r.doc_id for r in single.collect())
    assert ids == kept_by_brute_force([(i, rows[i].text) for i in sorted(good)])
    clean = cp.secret_scans(spark, single, small)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == ids
    for r in clean.collect():
        assert not re.search(r"token = \"[0-9a-f]{32}", r.text)
        if not any(re.search(x.pattern, rows[r.doc_id].text) for x in secrets.RULES):
            assert r.text == rows[r.doc_id].text
    mixed = cp.mix_sources(spark, clean, small)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 3 * len(ids)


def test_run_packs_the_mix(spark, small):
    pieces = cp.run(spark, small).selectExpr("doc_id", "start", "size(ids) n", "ids", "doc_tokens", "sequence_id", "offset").collect()
    assert pieces and max(p.offset + p.n for p in pieces) <= 1024
    for p in pieces[:20]:
        assert p.n > 0 and p.start + p.n <= p.doc_tokens
    assert all(p.ids[-1] == 0 for p in pieces if p.start + p.n == p.doc_tokens)
    assert whole("byte_bpe_50k.json", "", 0) == [0]
    assert cp.STAGES[-1][0] == "pack_windows" and cp.ORACLE_SQL is None


def masked(text):
    spans = [m.span() for r in secrets.RULES for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_run_is_brute_force(spark, small):
    """All stages at once: which documents, with what text, how often, and every id of every copy in a window."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    good = [(i, r.text) for i, r in sorted(rows.items()) if not quality_brute(r.text)[5]]
    texts = {i: masked(rows[i].text) for i in kept_by_brute_force(good)}
    pieces = cp.run(spark, small).select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset").collect()
    windows, taken = defaultdict(list), Counter()
    covered = {i: Counter() for i in texts}
    ids = {i: whole("byte_bpe_50k.json", t, 0) for i, t in texts.items()}
    for p in pieces:
        assert p.ids == ids[p.doc_id][p.start : p.start + len(p.ids)] and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id].update(range(p.start, p.start + len(p.ids)))
        windows[p.sequence_id].append((p.offset, len(p.ids)))
    for held in windows.values():
        ends = [0]
        for offset, n in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 1024
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    sizes, most = Counter(), Counter()
    for i in texts:
        copies = {covered[i][k] for k in range(len(ids[i]))}
        assert len(copies) == 1 and 0 <= min(copies) <= 3  # every id of a document as often as the others
        source = rows[i].source
        sizes[source] += words[i]
        taken[source] += words[i] * min(copies)
        most[source] = max(most[source], words[i])
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)


def test_edges_of_every_stage(spark, tmp_path):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "a"), (2, clean, "a"), (None, clean + " x", None), (3, None, "a"), (4, "", None), (5, f"{clean.replace('word', 'five')} token=abcdefgh12 q{'r' * 90000}", "b"), (6, clean.replace("word", "other"), "b")]
    rows += [(7, " ".join(f"seven{i}" for i in range(60)), "b")] * 3
    names = ["_qr_w", "_nd_id", "_sc_k1", "_mx_size", "found", "_k1", "_domain", "_copy", "fp"]
    docs = spark.createDataFrame([(i, t, "en", s, 0, *range(9)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        assert stage(spark, docs, "").count() > 0, name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} <= {1, 5, 6, 7} and {5, 6, 7} & {p.doc_id for p in pieces}
    kept = cp.near_dedup(spark, cp.quality_rules(spark, docs, ""), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 5, 6, 7] and kept[0]._k1 == 5

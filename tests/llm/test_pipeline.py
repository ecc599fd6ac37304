"""The corpus pipeline, stage by stage and whole, against what each stage promises."""

import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from partslake.llm import forest, toxicity
from partslake.llm.simhash import fingerprint
from tests.llm.test_forest import plain, shingles
from tests.llm.test_secrets import brute as secret_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(stages[0], labels)
    scores = {r.doc_id: r.score for r in toxicity.score(stages[0], model, ["doc_id"]).collect()}
    kept = sorted(r.doc_id for r in stages[1].collect())
    assert kept == sorted(i for i, s in scores.items() if s < 0.7)
    clean = {r.doc_id for r in labels.filter("toxic = 0").collect()} & set(scores)
    assert len(clean - set(kept)) <= 0.01 * len(clean) and len(kept) < len(scores)


def kept_of(rows):
    """Ids of the texts that stay: the smallest id of each group, all texts without words being one."""
    data = [(r.doc_id, r.text) for r in rows]
    blank = [i for i, t in data if not (t or "").encode().split()]
    return sorted(i for i, n, low in plain(data, 5, (4, 5))[0] if (i == low if n else i == min(blank)))


def test_one_of_each_group_stays(stages):
    before = stages[1].collect()
    assert sorted(r.doc_id for r in stages[2].collect()) == kept_of(before)


def test_one_of_each_group_stays_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).collect()) == kept_of(docs.collect())


@pytest.mark.parametrize("changed, kept", [(9, 1), (12, 2)])
def test_near_duplicates_by_similarity(spark, rows, changed, kept):
    """Texts of 0.8 to 0.85 similarity are one, those below 0.8 are two."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(500)]
    copy = list(base)
    for k in range(changed):
        copy[20 * k + 10] = "changed"
    data = [(1, " ".join(base), "en", "web", 1), (2, " ".join(copy), "en", "web", 1), (3, " ".join(copy), "en", "web", 1)]
    docs = rows(data, "doc_id long, text string, lang string, source string, n_chars long")
    x, y = shingles(data[0][1], 5), shingles(data[1][1], 5)
    share = len(x & y) / len(x | y)
    assert 0.8 <= share < 0.85 if kept == 1 else 0.75 < share < 0.8
    assert [r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).orderBy("doc_id").collect()] == [1, 2][:kept]


def test_the_trie_links_close_texts_and_the_forest_the_rest(spark, rows, monkeypatch):
    """Without the forest, texts at a few bits are one, and a link of the trie that the sets deny is none."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    close, far = base[:-1] + ["changed"], list(base)
    for k in range(10):
        far[40 * k + 10] = "changed"
    repeated = base[:41] * 100  # shingles count as often as they occur in a fingerprint, once in a set
    denied = repeated + [f"x{k}" for k in range(12)]
    data = [(i, " ".join(t), "en", "web", 1) for i, t in enumerate([base, close, far, repeated, denied])]
    docs = rows(data, "doc_id long, text string, lang string, source string, n_chars long")
    bits = lambda i, j: bin(fingerprint(data[i][1].encode(), 3) ^ fingerprint(data[j][1].encode(), 3)).count("1")
    assert bits(0, 1) <= 2 < bits(0, 2) and bits(3, 4) <= 2
    kept = lambda: [r.doc_id for r in C.drop_near_duplicates(spark, docs, SF).orderBy("doc_id").collect()]
    assert kept() == [0, 3, 4]
    with monkeypatch.context() as m:
        m.setattr(forest, "partners", lambda posts, similar: spark.createDataFrame([], "node long, other long"))
        assert kept() == [0, 2, 3, 4]
    assert [i for i, n, low in plain([d[:2] for d in data], 5, (4, 5))[0] if i == low] == [0, 3, 4]


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_on_nulls_and_an_empty_table(spark, rows, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, node int, source_ string"
    assert stage(spark, rows([], schema), SF).collect() == []
    data = [(None, None, None, None, None, 1, 1, "x"), (1, "", "en", None, 0, 2, 1, None), (2, "a few clean words", None, "web", 17, 3, 1, "")]
    out = stage(spark, rows(data, schema), SF).collect()
    assert 2 in {r.doc_id for r in out} and len(out) >= 2


def test_secrets_are_masked_and_nothing_else(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys() and stages[3].columns == C.COLUMNS
    for i, r in before.items():
        if secret_spans(r.text):
            assert "[SECRET]" in after[i].text and not [s for s in secret_spans(after[i].text) if s[3] == "access"]
        else:
            assert after[i] == r


def test_mixing_keeps_every_document(stages):
    before, after = stages[3].collect(), Counter(map(tuple, stages[4].collect()))
    assert {tuple(r) for r in before} == set(after) and set(after.values()) <= {1, 2, 3} and stages[4].columns == C.COLUMNS


def test_packing_holds_every_token(stages):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in stages[4].collect():
        want[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, used = Counter(), defaultdict(list)
    for r in stages[5].collect():
        got[r.doc_id] += r.length
        used[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in used.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(pieces), sorted(pieces)[1:])) and min(pieces)[0] == 0
    assert sum(want.values()) > 0.9 * 2048 * len(used)


def test_run_gives_the_last_stage(spark, stages):
    cols = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert Counter(map(tuple, C.run(spark, SF).select(*cols).collect())) == Counter(map(tuple, stages[5].select(*cols).collect()))

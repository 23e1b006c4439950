import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from llm.cases import WORD, components, lowered, quality, rows
from llm.test_mixing import shares
from llm.test_near_duplicates import near, shingles
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made[-1], SF_DIR).write.parquet(str(tmp_path / str(k)))
        made.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(m.dtypes == docs.dtypes for m in made[:-1])
    names = docs.columns

    first = {r for r in rows(docs, *names) if quality(r[1])[-1]}
    assert set(rows(made[1], *names)) == first and 0 < len(first) < docs.count()

    best = {}
    for r in first:
        best[lowered(r[1])] = max(best.get(lowered(r[1]), r), r)
    second = set(best.values())
    assert set(rows(made[2], *names)) == second and len(second) < len(first)

    order = sorted(second)
    third = {order[min(part)] for part in components([shingles(r[1]) for r in order], linked=near)}
    assert set(rows(made[3], *names)) == third and len(third) < len(second)

    sizes, taken = defaultdict(int), defaultdict(int)
    texts = {r[0]: r[1] for r in third}
    for r in third:
        sizes[r[3]] += len(WORD.findall(r[1]))
    fourth = rows(made[4], "doc_id", "text", "source", "n_chars")
    cut = Counter()
    for i, text, source, n_chars in fourth:
        taken[source] += len(WORD.findall(text))
        if text != texts[i]:
            cut[source] += 1
            assert WORD.findall(texts[i])[:len(text.split(" "))] == text.split(" ") and n_chars == len(text)
    assert {s: n for s, n in taken.items()} == {s: int(t + 0.5) for s, t in shares(sizes).items() if t >= 0.5}  # half a word counts as one
    assert max(cut.values(), default=1) == 1

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, _, _ in fourth:
        ids = library.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(rows(made[5], *names)) == want
    assert Counter(rows(corpus_pipeline.run(spark, SF_DIR), *names)) == want

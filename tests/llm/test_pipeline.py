import corpus_pipeline
import public_tokenizers
import tiktoken

from curvelens.llm import bpe
from tests.llm import test_decontaminate, test_near_dedup, test_substring_dedup


def test_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokenize":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x for x in docs.collect()}
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert kept["language"].keys() == texts.keys()
    groups = test_near_dedup.brute(texts)
    assert kept["near_dedup"].keys() == {k for k, v in groups.items() if v[2]}
    rows = {k: x.text for k, x in kept["near_dedup"].items()}
    cut = test_substring_dedup.brute(rows, 20)
    after = {k: x.text for k, x in kept["substring_dedup"].items()}
    assert {k: len(test_near_dedup.re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in after.items()} == {k: v[0] - v[1] for k, v in cut.items()}
    assert all(after[k] == rows[k] for k, v in cut.items() if v[1] == 0)
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {k for k, v in test_decontaminate.brute(after, items, 10).items() if not v[4]}
    assert kept["decontaminate"].keys() == clean
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for x in kept["tokenize"].values():
        assert x.round_trip and x.token_ids == own.encode_ordinary(x.text or "") and x.n_tokens == len(x.token_ids)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).filter("round_trip").count() > 100

import pytest

from lexmill.settings import Settings, parse_bool


@pytest.mark.parametrize(
    "bad",
    [
        {"dense_dim": 0}, {"dense_max_tokens": 0}, {"dense_batch": 0}, {"dense_timeout": 0}, {"chunk_size": 0}, {"chunk_overlap": 1000}, {"chunk_overlap": -1}, {"candidates_k": 0}, {"final_k": 0}, {"final_k": 41}, {"max_context_chars": 0},
        {"index_url": ""}, {"index_url": "ftp://x"}, {"index_timeout": 0}, {"index_batch": 0}, {"min_evidence_score": 1.1}, {"evidence_overlap": -0.1}, {"stem_overlap": 2}, {"min_shared_stems": 0}, {"llm_context": 4095},
        {"providers": ()}, {"providers": ("X",)}, {"require_cuda": True}, {"ocr_min_chars": -1}, {"ocr_min_confidence": 1.5}, {"ocr_dpi": 0}, {"score_mode": "softmax"}, {"weight_evidence": -0.1}, {"weight_authority": 0.5}, {"llm_timeout": 0},
        {"llm_max_tokens": 0}, {"repair_max_tokens": 0}, {"repair_max_tokens": 2000}, {"quantization": "int4"}, {"dense_url": "nada"}, {"records_per_court": 0}, {"min_records": 0}, {"min_records": 201},
    ],
    ids=str,
)
def test_every_check(bad):
    assert Settings(**bad).errors()
    with pytest.raises(ValueError):
        Settings(**bad).checked()


def test_all_faults_are_named_at_once():
    assert len(Settings(chunk_size=0, index_url="", score_mode="x").errors()) >= 3 and not Settings().errors()


def test_from_environment():
    s = Settings.from_environment({"LEXMILL_FINAL_K": "9", "LEXMILL_REQUIRE_CUDA": "off", "LEXMILL_PROVIDERS": "CPUExecutionProvider, CUDAExecutionProvider", "LEXMILL_BM25_B": "0.5", "OTHER": "1"})
    assert (s.final_k, s.require_cuda, s.providers, s.bm25_b) == (9, False, ("CPUExecutionProvider", "CUDAExecutionProvider"), 0.5)
    with pytest.raises(ValueError):
        Settings.from_environment({"LEXMILL_FINAL_K": "x"})
    assert parse_bool("sim") and not parse_bool(" No ")

"""Settings with their checks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlparse

#: What may be chosen, and the least context of a generator.
CHOICES = {"score_mode": ("sigmoid", "identity"), "quantization": ("int8", "none")}
PROVIDERS = ("CUDAExecutionProvider", "CPUExecutionProvider")
LEAST_CONTEXT = 4096


def parse_bool(raw: str) -> bool:
    """Everything but 0, false, no and off is yes."""
    return raw.strip().lower() not in ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    """What retrieval, chunking and the gate go by."""

    chunk_size: int = 1000
    chunk_overlap: int = 150
    dense_max_tokens: int = 512
    dense_dim: int = 1024
    candidates_k: int = 40
    final_k: int = 6
    context_neighbors: int = 1
    max_context_chars: int = 16_000
    min_evidence_score: float = 0.20
    evidence_overlap: float = 0.25
    stem_overlap: float = 0.20
    min_shared_stems: int = 2
    unit_cap: int = 2
    rrf_k: int = 2
    rank_base: int = 0
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    weight_evidence: float = 0.68
    weight_authority: float = 0.20
    weight_jurisdiction: float = 0.12
    records_per_court: int = 200
    min_records: int = 150
    # services that are injected: an index elsewhere, models behind an interface, readers of scans
    index_url: str = "http://127.0.0.1:6333"
    index_timeout: float = 30.0
    index_batch: int = 256
    quantization: str = "int8"
    dense_url: str = "http://127.0.0.1:8888/v1"
    dense_batch: int = 64
    dense_timeout: float = 120.0
    providers: tuple[str, ...] = ("CPUExecutionProvider",)
    require_cuda: bool = False
    score_mode: str = "sigmoid"
    ocr_min_chars: int = 80
    ocr_min_confidence: float = 0.60
    ocr_dpi: int = 250
    llm_timeout: float = 600.0
    llm_max_tokens: int = 1024
    repair_max_tokens: int = 256
    llm_context: int = 8192

    @classmethod
    def from_environment(cls, environment: Mapping[str, str], prefix: str = "LEXMILL_") -> Settings:
        """Settings named in an environment, the rest as they are; a value that can't be read is an error."""
        found = {}
        for f in fields(cls):
            if (raw := environment.get(prefix + f.name.upper())) is None:
                continue
            kind = type(getattr(cls, f.name))
            try:
                found[f.name] = parse_bool(raw) if kind is bool else tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw.strip())
            except ValueError as e:
                raise ValueError(f"{prefix}{f.name.upper()}: {raw!r} can't be read") from e
        return cls(**found)

    def errors(self) -> list[str]:
        """Everything that is wrong, none left out."""
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if not isinstance(v, int | float):
                continue
            if v < 0 or (f.name in _POSITIVE and v <= 0):
                out.append(f"{f.name} must be positive" if f.name in _POSITIVE else f"{f.name} must not be negative")
        for name in ("min_evidence_score", "evidence_overlap", "stem_overlap", "bm25_b", "ocr_min_confidence"):
            if getattr(self, name) > 1:
                out.append(f"{name} must not exceed 1")
        if self.chunk_overlap >= self.chunk_size:
            out.append("chunk_overlap must be less than chunk_size")
        if self.final_k > self.candidates_k:
            out.append("final_k must not exceed candidates_k")
        if abs(self.weight_evidence + self.weight_authority + self.weight_jurisdiction - 1) > 1e-9:
            out.append("the weights must sum to 1")
        if self.min_records > self.records_per_court:
            out.append("min_records must not exceed records_per_court")
        if self.repair_max_tokens > self.llm_max_tokens:
            out.append("repair_max_tokens must not exceed llm_max_tokens")
        if self.llm_context < LEAST_CONTEXT:
            out.append(f"llm_context must be {LEAST_CONTEXT} or more")
        for name in ("index_url", "dense_url"):
            url = urlparse(getattr(self, name))
            if url.scheme not in ("http", "https") or not url.netloc:
                out.append(f"{name} must be an address of http or https")
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                out.append(f"{name} must be one of {', '.join(allowed)}")
        if not self.providers or set(self.providers) - set(PROVIDERS):
            out.append(f"providers must be of {', '.join(PROVIDERS)}")
        if self.require_cuda and PROVIDERS[0] not in self.providers:
            out.append(f"require_cuda needs {PROVIDERS[0]} among the providers")
        return out

    def checked(self) -> Settings:
        """Itself, or one error that names all faults."""
        if found := self.errors():
            raise ValueError("; ".join(found))
        return self


_POSITIVE = frozenset("chunk_size dense_max_tokens dense_dim candidates_k final_k max_context_chars unit_cap bm25_k1 records_per_court min_records min_shared_stems index_timeout index_batch dense_batch dense_timeout ocr_dpi llm_timeout llm_max_tokens repair_max_tokens".split())

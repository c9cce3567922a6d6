"""The modules that register queries of this subpackage; each stands for itself."""

MODULES = [f"glosspan.llm.{name}" for name in ("exact_dedup", "pii", "decontamination", "mixing", "lm", "secrets", "licences", "language", "jaccard", "substrings", "chat", "importance", "clustering")]
MODULES.append("corpus_pipeline")

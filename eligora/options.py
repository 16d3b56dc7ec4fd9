"""Switches and sizes of an assessment, read from any mapping of texts such as ``os.environ``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from eligora import constants as K


@dataclass(frozen=True)
class Options:
    """What an assessment may use, and how much of it at once."""

    index: bool = True                                 # keep vector indexes at all
    index_summaries: bool = True                       # a summary of each document in the index
    evidence_from_index: bool = False                  # look for evidence by vectors, not by scanning documents
    reserve_documents: bool = False                    # a document serves one criterion per bidder
    money_model: bool = True                           # ask a model for amounts the rules are unsure of
    money_confidence: float = K.MONEY_MODEL_CONFIDENCE  # unsure below this
    batch_chunks: int = K.CHUNKS_PER_CALL              # chunks in one call of a scan
    vector_pool: int = K.VECTOR_POOL                   # near chunks taken from the index
    calls_at_once: int = 4                             # model calls in flight, over all workers

    @classmethod
    def read(cls, settings: Mapping[str, str], prefix: str = "ELIGORA_") -> Options:
        """Options named in ``settings`` (``ELIGORA_MONEY_MODEL=off``), the others as they are.

        A switch that is on by default is on unless spelt off, one that is off is off
        unless spelt on; a size that is no positive number raises ValueError.
        """
        found = {}
        for f in fields(cls):
            text = settings.get(prefix + f.name.upper())
            if text is None:
                continue
            word = text.strip().lower()
            if isinstance(f.default, bool):
                found[f.name] = word not in K.FALSE_WORDS if f.default else word in K.TRUE_WORDS
            else:
                found[f.name] = type(f.default)(word)
                if not found[f.name] > 0:
                    raise ValueError(f"{prefix}{f.name.upper()} must be above 0, not {text!r}")
        return cls(**found)

"""Settings of the aligner; their values enter plans as literals."""

from dataclasses import dataclass, field

OWL, SKOS, RDF, RDFS = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
CONCEPT, CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, INDIVIDUAL = SKOS + "Concept", OWL + "Class", OWL + "ObjectProperty", OWL + "DatatypeProperty", OWL + "NamedIndividual"
#: in the order in which a subject's types decide
TYPES = [CONCEPT, CLASS, OBJECT_PROPERTY, DATATYPE_PROPERTY, INDIVIDUAL]


def _thresholds() -> dict[str, float]:
    return {CLASS: 0.78, CONCEPT: 0.85, OBJECT_PROPERTY: 0.82, DATATYPE_PROPERTY: 0.82, INDIVIDUAL: 0.80}


def _thresholds_v1() -> dict[str, float]:
    return {CLASS: 0.80, CONCEPT: 0.92, OBJECT_PROPERTY: 0.82, DATATYPE_PROPERTY: 0.78, INDIVIDUAL: 0.82}


@dataclass(frozen=True)
class Settings:
    """Defaults are those behind the published numbers."""

    semantic_weight: float = 0.60
    string_weight: float = 0.40
    ngram_weight: float = 0.30
    levenshtein_weight: float = 0.35
    isub_weight: float = 0.35
    structural_bonus: float = 0.10
    hub_threshold: float = 4.0
    hub_step: float = 0.03
    hub_floor: float = 0.65
    floor_ratio: float = 0.72
    symmetry_tolerance: float = 0.20
    string_gate: float = 0.45
    overlap_gate: float = 0.25
    acronym_gate: float = 0.80
    sure_semantic: float = 0.88
    length_ratio: float = 2.5
    second_stage: float = 0.92
    second_stage_below: int = 50_000
    parents_below: int = 130_000
    #: "indel" or "levenshtein"
    lev_kernel: str = "indel"
    #: "exact", "ivf", "ivfpq", or "auto": by the targets of the largest type
    search: str = "auto"
    ivf_from: int = 1_000_000
    pq_from: int = 10_000_000
    probes_divisor: int = 16
    training_ratio: int = 39
    subquantizers: int = 16
    #: types of as many entities check this many sources in reverse
    wide_reverse_from: int = 60_000
    wide_reverse: int = 20
    other_threshold: float = 0.80
    thresholds: dict[str, float] = field(default_factory=_thresholds)
    thresholds_v1: dict[str, float] = field(default_factory=_thresholds_v1)
    #: None: from sizes (adaptive k); a number: that many candidates
    k: int | None = None
    #: None: found by the medical detector
    medical: bool | None = None
    #: "v2" or "v1"
    profile: str = "v2"
    #: as published, partial gold takes its known targets from the reference's sources
    partial_gold_compat: bool = True

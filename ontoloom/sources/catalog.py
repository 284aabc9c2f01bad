"""Finding ontologies, reference files and tasks in folders. Driver-side: names of files, not rows."""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from pathlib import Path

# Suffixes in order of preference, the tasks known by name, and where references lie under which names.
ONTOLOGY_SUFFIXES = [".owl", ".rdf", ".ttl", ".xml"]
BIO_TASKS = ["ncit-doid", "snomed-fma", "snomed-ncit"]
TABLE_FOLDERS = ["", "ontologies", "refs_equiv", "refs", "references", "reference"]
TABLE_SUFFIXES = [".tsv", ".csv"]
TABLE_NAMES = ["train.tsv", "test.tsv", "full.tsv", "reference.tsv"]
KG_FOLDERS = ["", "refs_equiv", "refs", "references", "reference", "ontologies"]
KG_SUFFIXES = [".ttl", ".rdf", ".owl", ".xml", ".tsv", ".csv"]
KG_NAMES = ["onto1-onto2.ttl", "onto1-onto2.rdf", "ref-align.rdf", "reference.rdf", "reference.ttl", "reference.tsv", "train.tsv", "test.tsv", "full.tsv"]


@dataclass(frozen=True)
class Task:
    """One alignment: two ontologies, and gold where there is any."""

    track: str
    name: str
    source: Path
    target: Path
    reference: Path | None


def _first(paths: Iterator[Path]) -> Path | None:
    return next((p for p in paths if p.is_file()), None)


def find_ontology(folder: Path, name: str) -> Path | None:
    """The ontology of a name, by the order of suffixes."""
    return _first(folder / f"{name}{s}" for s in ONTOLOGY_SUFFIXES)


def _both_ways(stem: str) -> list[str]:
    a, dash, b = stem.partition("-")
    return [stem, f"{b}-{a}"] if dash else [stem]


def find_table_reference(track: Path, stem: str) -> Path | None:
    """A table under a task's stem or its reverse in any of the usual folders, else one under a general name."""
    named = (track / folder / f"{name}{suffix}" for name, suffix, folder in product(_both_ways(stem), TABLE_SUFFIXES, TABLE_FOLDERS))
    general = (track / folder / name for folder, name in product(TABLE_FOLDERS, TABLE_NAMES))
    return _first(named) or _first(general)


def find_kg_reference(track: Path, stem: str) -> Path | None:
    """As find_table_reference(), in more formats, and also below folders that are named like the task."""
    folders = [track / base / folder for base, folder in product(["", *_both_ways(stem)], KG_FOLDERS)]
    named = (folder / f"{name}{suffix}" for folder, name, suffix in product(folders, _both_ways(stem), KG_SUFFIXES))
    general = (folder / name for folder, name in product(folders, KG_NAMES))
    return _first(named) or _first(general)


def _files(track: Path, suffixes: list[str]) -> list[Path]:
    return sorted(p for p in track.iterdir() if p.is_file() and p.suffix.lower() in suffixes)


def _by_references(track: Path) -> Iterator[Task]:
    """Turtle references beside a folder of ontologies. Names of two parts, or one that has human-mouse in it."""
    for ref in sorted([*track.glob("*.ttl"), *track.glob("references/*.ttl")], key=lambda p: p.name):
        parts = ref.stem.split("-")
        if len(parts) != 2:
            parts = ["human", "mouse"] if "human-mouse" in ref.stem else []
        found = [find_ontology(track / "ontologies", name) for name in parts]
        if parts and all(found):
            yield Task(track.name, ref.stem, *found, ref)


def _by_siblings(track: Path) -> Iterator[Task]:
    """A reference a-b among the ontologies a and b."""
    files = _files(track, ONTOLOGY_SUFFIXES)
    stems = {p.stem for p in files}
    for ref in files:
        a, dash, b = ref.stem.partition("-")
        if dash and {a, b} <= stems:
            yield Task(track.name, ref.stem, find_ontology(track, a), find_ontology(track, b), ref)


def _by_name(track: Path) -> Iterator[Task]:
    for stem in BIO_TASKS:
        found = [find_ontology(track, name) for name in stem.split("-")]
        if all(found):
            yield Task(track.name, stem, *found, find_table_reference(track, stem))


def _by_pair(track: Path) -> Iterator[Task]:
    files = _files(track, ONTOLOGY_SUFFIXES)
    if len(files) == 2:
        stem = f"{files[0].stem}-{files[1].stem}"
        yield Task(track.name, stem, *files, find_table_reference(track, stem))


def tasks(base: Path, v1: bool = False) -> Iterator[Task]:
    """Tasks of every track folder, in order of name: the first way of finding any is used for a track."""
    for track in sorted(p for p in base.iterdir() if p.is_dir()):
        for way in [_by_references] if v1 else [_by_references, _by_siblings, _by_name, _by_pair]:
            found = list(way(track))
            if found:
                yield from found
                break

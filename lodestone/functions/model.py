"""Kinds of symbols and relations, masks, weights and schemas of the code graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Symbol kinds by ordinal, and their labels in results.
KINDS = ["Function", "Class", "Struct", "Enum", "Variable", "Macro", "Alias", "Include", "Namespace", "Concept", "Interface", "File", "Unknown"]
KIND = {name: i for i, name in enumerate(KINDS)}
UNKNOWN = KIND["Unknown"]
KIND_LABELS = {i: {"Struct": "ClassNode", "Unknown": "Unknown"}.get(name, f"{name}Node") for i, name in enumerate(KINDS)}

# Relations by ordinal; each even one is stored, and the odd one after it is its inverse.
RELATIONS = ["Inherits", "DerivedBy", "MemberOf", "HasMember", "DefinedIn", "Contains", "Includes", "IncludedBy", "Calls", "CalledBy", "Returns", "ReturnedBy", "TypedAs", "TypeOf"]
RELATION = {name: i for i, name in enumerate(RELATIONS)}
ALL_RELATIONS = 0
#: All but DefinedIn, Contains, Includes and IncludedBy.
SEMANTIC_RELATIONS = sum(1 << i for i, name in enumerate(RELATIONS) if name not in ("DefinedIn", "Contains", "Includes", "IncludedBy"))

# What an edge weighs for a symbol of a kind.
WEIGHTS = {
    "Class": {"Inherits": 3, "DerivedBy": 2, "HasMember": 3, "Contains": 2, "MemberOf": 1},
    "Struct": {"Inherits": 3, "DerivedBy": 2, "HasMember": 3, "Contains": 2, "MemberOf": 1},
    "Function": {"Calls": 3, "CalledBy": 2, "Returns": 2, "TypedAs": 1, "MemberOf": 1},
    "Variable": {"TypedAs": 2, "MemberOf": 1},
    "Enum": {"Contains": 2, "MemberOf": 1},
    "Macro": {"Contains": 1},
}

#: Names that a traversal visits, its start included.
VISIT_CAP = 10_000

SYMBOL_SCHEMA = T.StructType(
    [
        T.StructField("symbol_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("kind", T.ByteType()), T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("signature", T.StringType()), T.StructField("parent_class", T.StringType()),
    ]
)
EDGE_SCHEMA = T.StructType([T.StructField("edge_id", T.LongType()), T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("relation", T.ByteType())])


def relation_bit(relation: int | str) -> int:
    return 1 << (RELATION[relation] if isinstance(relation, str) else relation)


def inverse(relation: int) -> int:
    return relation ^ 1


def default_weights() -> dict[tuple[int, int], float]:
    return {(KIND[k], RELATION[r]): float(w) for k, row in WEIGHTS.items() for r, w in row.items()}


@dataclass(frozen=True)
class DensityConfig:
    """Limits of a smart query. max_expansions is accepted and has no effect; there is one conditional expansion."""

    score_threshold: float = 5.0
    min_edge_types: int = 2
    max_expansions: int = 3
    goldilocks_min: int = 5
    goldilocks_max: int = 200
    weights: dict[tuple[int, int], float] = field(default_factory=default_weights)


def _labels(names: dict[int, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def kind_label(kind: Column) -> Column:
    return F.coalesce(F.element_at(_labels(KIND_LABELS), kind.cast("int")), F.lit("Unknown"))


def kind_of_label(label: Column) -> Column:
    """Struct and Class share a label, which means Class."""
    back = {v: k for k, v in KIND_LABELS.items() if k != KIND["Struct"]}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in back.items() for x in pair)), label), F.lit(UNKNOWN)).cast("int")


def relation_label(relation: Column) -> Column:
    return F.element_at(_labels(dict(enumerate(RELATIONS))), relation.cast("int"))


def inverse_of(relation: Column) -> Column:
    return relation.cast("int").bitwiseXOR(F.lit(1))


def in_mask(relation: Column, mask: int) -> Column:
    """Whether a stored relation is in the mask; 0 stands for all."""
    chosen = [i for i in range(len(RELATIONS)) if mask >> i & 1]
    return F.lit(True) if mask == ALL_RELATIONS else relation.isin(*chosen) if chosen else F.lit(False)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# Languages by file extension.
EXTENSIONS = {
    "c": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "hxx": "cpp", "py": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "javascript", "ts": "typescript", "mts": "typescript", "tsx": "tsx", "rs": "rust", "go": "go", "cs": "csharp",
}


# The labels that reports give files, by extension; others are "Other".
EXTENSION_LABELS = {
    "c": "C", "h": "C/C++", "cpp": "C++", "cxx": "C++", "cc": "C++", "hpp": "C++", "hxx": "C++", "py": "Python", "java": "Java", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "jsx": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "tsx": "TypeScript", "rs": "Rust", "go": "Go", "cs": "C#",
}


def report_label(path: Column) -> Column:
    """The label of a file in reports, by the text after its last dot."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in EXTENSION_LABELS.items() for x in pair)), ascii_lower(F.substring_index(path, ".", -1)))
    return F.when(F.instr(path, ".") > 0, F.coalesce(found, F.lit("Other"))).otherwise(F.lit("Other"))


def language_of(path: Column) -> Column:
    """The language that the text after the last dot stands for, '' for none."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair)), ascii_lower(F.substring_index(path, ".", -1)))
    return F.when(F.instr(path, ".") > 0, F.coalesce(found, F.lit(""))).otherwise(F.lit(""))


def language_of_path(path: str) -> str:
    _, dot, end = path.rpartition(".")
    return EXTENSIONS.get(end.lower(), "") if dot else ""

"""Scalar rules on entities, relations and numbers, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered (substrings, name) rules for relation names; the first that matches wins. Words that hold one of
# these are left out, since it finds them too.
CANONICAL_RELATIONS = (
    (("activate", "upreg", "induce", "promote", "enhance", "positive"), "activates"),
    (("inhibit", "suppres", "repress", "downreg", "decrease", "negative", "knockdown", "knockout"), "inhibits"),
    (("belong", "member_of"), "belongs_to"),
    (("pathway", "participat", "member"), "participates"),
    (("express", "transcript"), "expresses"),
    (("meth",), "has_methylation"),
    (("cnv", "copy_number", "copy-number"), "has_cnv"),
    (("protein_abundance", "proteomic", "rppa", "cptac"), "has_protein_abundance"),
    (("condition",), "has_condition"),
    (("regulat", "target"), "regulates"),
)
PASS_THROUGH = ("affects_", "targets_", "has_perturbation")
RELATIONS = tuple(sorted(name for _, name in CANONICAL_RELATIONS)) + ("associated_with",)
METHODS = ("KO", "KD", "OE", "CRISPRI", "CRISPRA", "RNAI", "INHIBIT")
# Sign vocabularies, which differ by where a sign is read. (negative, positive, otherwise)
SIGN_AT_INGEST = (("inhibit", "suppress", "repress", "down", "decrease", "negative"), ("activ", "enhanc", "induce", "up", "increase", "positive", "promote"), 0.0)
SIGN_AT_SAVE = (("inhibit", "suppress", "repress", "block", "down", "decrease", "negative"), ("activ", "enhanc", "induce", "up", "increase", "positive", "promote"), 1.0)
SIGN_AT_QUERY = (("inhibit", "suppress", "repress"), ("activ", "enhanc", "increase", "promote"), 1.0)
# Which types a relation may join.
TYPE_GATE = (
    (("belongs_to",), ("gene", "protein", "pathway", "sample", "mirna"), ("Cell",)),
    (("participates",), ("gene", "protein"), ("pathway",)),
    (("activates", "inhibits"), ("gene", "protein"), ("gene", "protein")),
    (("expresses", "has_protein_abundance", "has_cnv", "has_methylation"), ("sample", "Cell"), ("gene", "protein", "mirna")),
    (("has_condition",), ("sample", "Cell"), ("condition",)),
    (("regulates",), ("mirna",), ("gene", "protein")),
)
# Modality names, the relation they give, and the prefix of their entities.
MODALITIES = (
    (("expression", "rna", "transcriptome"), "expresses", "gene"),
    (("proteomics", "protein", "rppa", "cptac"), "has_protein_abundance", "protein"),
    (("methylation", "meth"), "has_methylation", "gene"),
    (("cnv", "copy_number", "copy-number"), "has_cnv", "gene"),
    (("mirna", "mi_rna", "micro_rna"), "expresses", "mirna"),
)


def or_else(c: Column, default: float | Column) -> Column:
    """A number read back: null and 0 both mean the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == 0), d).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once a row, however often the body reads it, and outside generated code, which
    long rules would outgrow."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(c: Column, tokens: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(c, F.lit(t))
    return out


def normalize_entity(c: Column) -> Column:
    """Trimmed, each run of white space one underscore; null gives empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", ""), r"\s+", "_")


def _starts_any(c: Column, heads: Sequence[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(c, F.lit(h))
    return out


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _base(text: Column) -> Column:
    """What stands behind the first '::', or all of the text if nothing does."""
    value = F.regexp_replace(text, r"(?s)^.*?::", "")
    return normalize_entity(F.when(value == "", text).otherwise(value))


def canonical_entity(c: Column, is_known_gene: Column | None = None) -> Column:
    """The entity id with one of seven prefixes. ``is_known_gene`` tells whether the upper-cased base is a known symbol."""
    known = F.lit(False) if is_known_gene is None else F.coalesce(is_known_gene, F.lit(False))

    def made(x: Column) -> Column:
        prefix, base, upper = x["prefix"], x["base"], F.upper(x["base"])
        gene, protein = F.concat(F.lit("gene::"), upper), F.concat(F.lit("protein::"), base)
        out = F.when(x["text"] == "", F.lit(""))
        for names, form in (
            (("cell", "cell_context"), F.concat(F.lit("Cell::"), base)), (("sample",), F.concat(F.lit("sample::"), base)), (("condition",), F.concat(F.lit("condition::"), base)),
            (("mirna", "mi_rna", "micro_rna"), F.concat(F.lit("mirna::"), upper)), (("protein",), protein), (("pathway", "term"), F.concat(F.lit("pathway::"), base)),
            (("gene", "ncbi_gene", "ensembl_gene"), gene),
        ):
            out = out.when(prefix.isin(*names), form)
        is_protein = F.startswith(upper, F.lit("ENSP")) | F.startswith(base, F.lit("9606."))
        out = out.when(x["known"], gene).when(is_protein, protein)
        return out.when((prefix != "rna_or_protein") & _starts_any(upper, ("R-HSA", "WP", "HSA")), F.concat(F.lit("pathway::"), base)).otherwise(gene)

    def parts(text: Column) -> Column:
        prefix = F.when(F.contains(text, F.lit("::")), F.lower(F.substring_index(text, "::", 1))).otherwise(F.lit(""))
        return F.struct(text.alias("text"), prefix.alias("prefix"), _base(text).alias("base"), known.alias("known"))

    return let(let(_trimmed(c), parts), made)


def entity_symbol(c: Column) -> Column:
    """The upper-cased base by which ``canonical_entity`` looks an id up among known genes."""
    return let(_trimmed(c), lambda text: F.upper(_base(text)))


def canonical_relation(c: Column) -> Column:
    """The relation's canonical name. Canonical names are their own, so graphs already built skip the rules."""

    def made(raw: Column) -> Column:
        out = F.when(raw == "", F.lit("associated_with")).when(_starts_any(raw, PASS_THROUGH), raw)
        for tokens, name in CANONICAL_RELATIONS:
            out = out.when(contains_any(raw, tokens), F.lit(name))
        return out.otherwise(F.lit("associated_with"))

    return F.when(c.isin(*RELATIONS), c).otherwise(let(F.lower(normalize_entity(c)), made))


def relation_sign(c: Column, vocabulary=SIGN_AT_INGEST) -> Column:
    """-1, 1 or the vocabulary's default; negatives are looked for first."""
    negative, positive, otherwise = vocabulary
    return let(F.lower(normalize_entity(c)), lambda raw: F.when(contains_any(raw, negative), F.lit(-1.0)).when(contains_any(raw, positive), F.lit(1.0)).otherwise(F.lit(float(otherwise))))


def number(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def clamp01(c: Column, default: float = 0.5) -> Column:
    x = number(c, default)
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def as_gene(c: Column) -> Column:
    return F.concat(F.lit("gene::"), F.upper(normalize_entity(c)))


def as_protein(c: Column) -> Column:
    return F.concat(F.lit("protein::"), normalize_entity(c))


def as_pathway(c: Column) -> Column:
    return F.concat(F.lit("pathway::"), normalize_entity(c))


def typed_entity(value: Column, kind: Column) -> Column:
    """``entity_from_type`` of a normalised name and a normalised lower-case hint."""
    return (F.when(value == "", F.lit("")).when(F.contains(kind, F.lit("protein")), F.concat(F.lit("protein::"), value))
            .when(contains_any(kind, ("mirna", "micro")), F.concat(F.lit("mirna::"), F.upper(value)))
            .when(F.contains(kind, F.lit("sample")), F.concat(F.lit("sample::"), value))
            .when(F.contains(kind, F.lit("condition")), F.concat(F.lit("condition::"), value)).otherwise(F.concat(F.lit("gene::"), F.upper(value))))


def entity_from_type(name: Column, hint: Column) -> Column:
    return typed_entity(normalize_entity(name), F.lower(normalize_entity(hint)))


def evidence(raw: Column, **structured: Column) -> Column:
    """JSON text {"raw": ..., "structured": {...}}."""
    return F.to_json(F.struct(raw.alias("raw"), F.struct(*(v.alias(k) for k, v in structured.items())).alias("structured")), {"ignoreNullFields": "false"})


NODE_TYPES = ("gene", "protein", "pathway", "sample", "condition", "mirna")


def node_type(c: Column, otherwise: str = "entity", cell: str = "Cell") -> Column:
    """The type by prefix alone."""
    low = F.lower(c)
    out = F.when(F.startswith(low, F.lit("cell::")), F.lit(cell))
    for t in NODE_TYPES:
        out = out.when(F.startswith(low, F.lit(t + "::")), F.lit(t))
    return out.otherwise(F.lit(otherwise))


def canonical_node_type(c: Column) -> Column:
    """The type of the canonical form of an id; unknown is Cell."""
    return node_type(canonical_entity(c), "Cell")


def token_node_type(c: Column) -> Column:
    """The type of a text token: gene unless it says otherwise."""
    low = F.lower(c)
    return (F.when(F.startswith(low, F.lit("gene::")), F.lit("gene"))
            .when(F.startswith(low, F.lit("protein::")) | F.startswith(c, F.lit("9606.")) | F.startswith(low, F.lit("ensp")), F.lit("protein"))
            .when(F.startswith(low, F.lit("pathway::")), F.lit("pathway")).when(contains_any(low, ("a549", "cell")), F.lit("Cell")).otherwise(F.lit("gene")))


def storage_type(c: Column) -> Column:
    """A relation as a storage name: letters, digits, underscores, upper case."""
    name = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9_]", "_")), r"^_+|_+$", "")
    return F.when(name == "", F.lit("RELATED_TO")).when(name.rlike(r"^[0-9]"), F.concat(F.lit("REL_"), name)).otherwise(name)


def gate_relation(rel: Column, head_type: Column, tail_type: Column) -> Column:
    """The relation if it may join these types, else associated_with."""
    ok = _starts_any(rel, PASS_THROUGH)
    for names, heads, tails in TYPE_GATE:
        ok = ok | (rel.isin(*names) & head_type.isin(*heads) & tail_type.isin(*tails))
    return F.when(ok, rel).otherwise(F.lit("associated_with"))


def flips(head_type: Column, tail_type: Column) -> Column:
    """Whether Cell -> gene, protein or pathway turns round to belongs_to."""
    return (head_type == "Cell") & tail_type.isin("gene", "protein", "pathway")


def pathway_name(tail: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(tail, r"(?s)^.*?::", ""), "_", " "))


def modality_relation(modality: Column) -> Column:
    out, low = F.when(F.lit(False), F.lit("")), F.lower(F.trim(modality))
    for names, rel, _ in MODALITIES:
        out = out.when(low.isin(*names), F.lit(rel))
    return out.otherwise(F.lit("associated_with"))


def modality_prefix(modality: Column) -> Column:
    out, low = F.when(F.lit(False), F.lit("")), F.lower(F.trim(modality))
    for names, _, prefix in MODALITIES:
        out = out.when(low.isin(*names), F.lit(prefix))
    return out.otherwise(F.lit("gene"))


def perturbation_node(method: Column, gene: Column) -> Column:
    return F.concat(F.lit("pathway::perturbation::"), F.upper(normalize_entity(method)), F.lit("_"), F.upper(normalize_entity(gene)))


def method_node(method: Column) -> Column:
    return F.concat(F.lit("pathway::perturb_method::"), F.upper(normalize_entity(method)))


def query_node(name: Column) -> Column:
    """The node a perturbation name asks for; a fully qualified name is lower-cased."""
    text = F.translate(F.upper(F.trim(F.coalesce(name, F.lit("")))), "- ", "__")
    return (F.when(text == "", F.lit("pathway::perturbation::UNKNOWN")).when(F.startswith(text, F.lit("PATHWAY::PERTURBATION::")), F.lower(text))
            .otherwise(F.concat(F.lit("pathway::perturbation::"), text)))


def is_biological_pathway(node: Column) -> Column:
    return F.startswith(node, F.lit("pathway::")) & ~_starts_any(node, ("pathway::perturbation::", "pathway::perturb_method::"))


def gene_token(node: Column) -> Column:
    """The symbol of a gene node, empty for other nodes."""
    return F.when(F.startswith(node, F.lit("gene::")), F.substring(node, 7, 1 << 30)).otherwise(F.lit(""))


def is_id_like(label: Column) -> Column:
    """Numbers and accession numbers, and an empty label, tell a reader nothing."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return (text == "") | text.rlike(r"^\p{Nd}+$") | _starts_any(F.upper(text), ("ENSG", "ENSMUSG"))


def is_symbol_like(token: Column) -> Column:
    return F.coalesce(token.rlike(r"\p{L}") & (F.length(token) >= 2), F.lit(False))


def perturbation_sign(name: Column) -> Column:
    return F.when(contains_any(F.lower(name), ("ko", "knockout", "inhibit", "kd")), F.lit(-1.0)).otherwise(F.lit(1.0))


def calibration_factor(log2_fc: Column) -> Column:
    return F.greatest(F.lit(0.7), F.least(F.lit(2.0), F.lit(1.0) + F.lit(0.35) * F.abs(log2_fc)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    x, y = F.size(a), F.size(b)
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when((x == 0) | (y == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def strip_symbol(c: Column) -> Column:
    """The symbol of 'SYM (123)', upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s*\(.*$", "")))


def delta_label(delta: Column) -> Column:
    return F.when(delta > 0, F.lit("增强")).when(delta < 0, F.lit("抑制")).otherwise(F.lit("不确定"))


def percent(c: Column, digits: int = 2) -> Column:
    """A share as text with a percent sign."""
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def suffix(c: Column) -> Column:
    """What stands behind the last '::' of an id."""
    return F.substring_index(c, "::", -1)

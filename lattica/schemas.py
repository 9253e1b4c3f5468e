"""Fixed schemas of the graph tables."""

TRIPLE = "head string, relation string, tail string, source string, version string, evidence string, weight double, confidence double, effect_sign double"
TRIPLE_CSV = "head string, relation string, raw_relation string, tail string, source string, version string, evidence string, weight double, confidence double, effect_sign double"
NODE = "name string, type string, is_seed boolean, pathway_name string"
EDGE_COLUMNS = ("head", "relation", "tail", "source", "version", "evidence", "weight", "confidence", "effect_sign")
OMICS_SPEC = (
    "name string, modality string, source string, version string, matrix_path string, matrix_format string, delimiter string, genes_path string,"
    " cells_path string, sample_metadata_path string, sample_id_column string, cell_line_column string, condition_column string, target_map_path string,"
    " top_k int, min_value double, confidence double")

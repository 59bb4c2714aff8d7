"""Fixed schemas of the file formats; readers never infer types."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

CLUSTER_PAIRS = _struct(rep=_S, member=_S)
HINTS = _struct(
    exact_sequence_rep_id=_S, candidate_uniprot_accession=_S, candidate_afdb_entry_id=_S,
    candidate_bfvd_model_id=_S, candidate_viro3d_identifier=_S, candidate_viro3d_qualifier=_S,
)
HIT_METADATA = _struct(
    accession=_S, model_id=_S, confidence_score=_D, ptm_score=_D, version=_S, dataset_tier=_S
)
HIT_INDEX = _struct(model_id=_S, range_offset=_L, range_length=_L)
RUN_SUMMARY = _struct(
    variant=_S, seed=_L, modalities=_struct(sequence=_B, structure=_B, context=_B)
)
_HEAD = _struct(accuracy=_D, macro_f1=_D)
RUN_METRICS = _struct(
    l1=_HEAD, l2=_HEAD, l3=_HEAD, hierarchy_violation_rate=_D,
    mean_gates=_struct(sequence=_D, structure=_D, context=_D),
)

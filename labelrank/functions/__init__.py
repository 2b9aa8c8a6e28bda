from labelrank.functions.columns import (  # noqa: F401
    NULL_TOKENS,
    above,
    drop_columns,
    integer_label,
    keep_columns,
    nan_to_null,
    null_nans,
    null_tokens,
    numeric_columns,
    string_columns,
    to_float32,
)
from labelrank.functions.hashing import hash_uniforms, key_hash, key_uniform  # noqa: F401

from .columns import (  # noqa: F401
    nan_to_null,
    nan_to_null_all,
    ratio,
    ratio_or_zero,
    r4,
    rnd,
    r6,
    is_double,
    typed_null,
)

"""auditlake: audit captured language-model traffic with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few helpers that run inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"


def configure(spark):
    """Settings of a session that results depend on; audits refuse to run without them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A repeated JSON key keeps its last value, as other JSON readers do.
    spark.conf.set(DUPLICATE_KEYS, "true")
    return spark


def require_configured(spark) -> None:
    if spark.conf.get(DUPLICATE_KEYS, "false") != "true":
        raise ValueError("call auditlake.configure(spark) first: without it a repeated JSON key changes what is audited")

"""Session settings the plans count on."""

# On a cluster: let Spark size partitions at run time and split skewed joins even
# where that costs a shuffle. Many first partitions cost little, since small
# ones are merged again.
CLUSTER = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
}


def apply(builder, settings=None):
    """Put settings on a session builder. `spark.checkpoint.dir` is the cluster's own."""
    for name, value in (settings or CLUSTER).items():
        builder = builder.config(name, value)
    return builder

"""Session options for cluster runs.

They go to ``SparkSession.builder``; nothing in the package changes the options
of a session it is given.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes shuffle reads, splits skewed join partitions and
# turns a shuffle join into a broadcast when a side turns out to be small.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where what follows could have used its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

# Splits and reads of 128 to 256 MB fit an executor core with a few GB.
SIZES = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
}

# Joins in which one side chooses: the other side's scan drops rows by a Bloom filter of the keys
# where these are too large to broadcast, and opens only the partitions that the keys name.
PRUNING = {
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
}

# Lost executors: shuffle files move off before a planned loss and stages retry.
RESILIENCE = {
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.stage.maxConsecutiveAttempts": "8",
    "spark.task.maxFailures": "8",
}


def initial_partitions(shuffled_bytes: int, target_bytes: int = 128 * 1024 * 1024, at_least: int = 200) -> int:
    """Shuffle partitions to start from; adaptive execution merges the small ones."""
    return max(at_least, -(-shuffled_bytes // target_bytes))


def cluster_session(app: str, checkpoint_dir: str, shuffled_bytes: int) -> SparkSession:
    """Session for a cluster; ``checkpoint_dir`` is a folder that all executors share."""
    options = {
        **ADAPTIVE,
        **SIZES,
        **PRUNING,
        **RESILIENCE,
        "spark.sql.shuffle.partitions": str(initial_partitions(shuffled_bytes)),
        "spark.checkpoint.dir": checkpoint_dir,
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(app)
    for name, value in options.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()

"""What ran where: the execution record that goes into the report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from statewave.config import AccelerationConfig


@dataclass
class Runtime:
    spark: SparkSession
    requested: AccelerationConfig
    stage_results: dict[str, dict] = field(default_factory=dict)

    def record_stage(self, stage: str, detail: str) -> None:
        self.stage_results[stage] = {"accelerated": False, "detail": detail}

    def info(self) -> dict:
        return {
            "backend_requested": self.requested.backend,
            "backend_used": "spark",
            "device_requested": self.requested.device,
            "device_used": "cpu",
            "active": False,
            "reason": "Work runs on Spark executors; GPU settings have no effect.",
            "spark_version": self.spark.version,
            "master": self.spark.sparkContext.master,
            "shuffle_partitions": self.spark.conf.get("spark.sql.shuffle.partitions"),
            "stage_results": self.stage_results,
        }

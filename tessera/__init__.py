"""tessera: template-driven data standardisation on Spark.

Main entry points::

    from tessera import build_session, load_spec, run_job
    spark = build_session()
    result = run_job(spark, load_spec("x.df-template.json"), "in/", "out/", kind="csv")
"""

from .plans.combine import run_combine
from .plans.job import JobResult, retry_quarantined, run_job, scan
from .plans.transform import Transformed, transform
from .session import build_session, ensure_checkpoint_dir
from .spec import HeaderCell, JobSpec, load_spec, save_spec
from .streaming.incremental import start_incremental

__all__ = [
    "HeaderCell", "JobResult", "JobSpec", "Transformed", "build_session", "ensure_checkpoint_dir",
    "load_spec", "retry_quarantined", "run_combine", "run_job", "save_spec", "scan", "start_incremental",
    "transform",
]

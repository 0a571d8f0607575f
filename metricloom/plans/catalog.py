"""All registered queries: importing the query modules fills the registry."""

from metricloom.plans import q_decide, q_detect, q_knowledge, q_library, q_oplog, q_quality, q_storage, q_stream, q_thresholds  # noqa: F401
from metricloom.plans.registry import REGISTRY  # noqa: F401

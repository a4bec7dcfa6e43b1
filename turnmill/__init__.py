"""Post-training data jobs on Spark: chat-trace import, dataset shaping,
rollout batch math, agent-task logs and run metrics."""

__version__ = "0.1.0"

"""Jobs: training loops, worker tasks and sweeps over parameters."""

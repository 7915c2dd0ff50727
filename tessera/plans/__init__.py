"""What a frame knows beside its Spark plan."""

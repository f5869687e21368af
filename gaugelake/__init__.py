"""Water-level sensor, tide-gauge and roadside-camera analytics on Spark."""

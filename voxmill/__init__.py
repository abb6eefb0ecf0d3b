"""voxmill: voxel, depth-scan and sensor-series analytics as PySpark DataFrame operators."""

"""gridloom: array algebra over voxel grids and tables, planned by Spark SQL."""

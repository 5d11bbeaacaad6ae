"""Expression text shared by operators, and the kernels of sequential scans."""

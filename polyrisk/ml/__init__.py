"""Model fitting as Spark jobs: numpy kernels, full-batch training, MLlib logistic, search."""

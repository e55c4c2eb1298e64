from loadweave.functions import metrics, scalar, timefn

__all__ = ["metrics", "scalar", "timefn"]

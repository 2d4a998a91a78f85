from churnscope.plans import cohort, staging
from churnscope.plans.cohort import CohortInputs

__all__ = ["CohortInputs", "cohort", "staging"]

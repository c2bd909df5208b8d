"""Comparison plans: what is asked (``spec``) and the object that answers (``comparison``)."""

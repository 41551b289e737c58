"""Spark jobs over event-delivery data: validate, store once, reconcile, audit."""

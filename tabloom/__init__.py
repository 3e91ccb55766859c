"""tabloom: tabular preparation, mining and modelling as Spark jobs."""

__version__ = "0.1.0"

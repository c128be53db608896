"""formweave: form-field mapping, application tracking and usage events on Spark."""
